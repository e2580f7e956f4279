"""The operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import decontamination, exact_dedup, html_extract, language_id, licenses, packing, pii, simhash, toxicity, warc
from brightloom.llm.common import cut, run_dir, table


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as monolithic crawl files, normalised: the index of every record."""
    files = cut(warc.monoliths(table(spark, sf_dir, "pages"), run_dir(spark, "crawl")))
    # a file is a task's work, so each row of the list is a partition's
    listed = files.repartitionByRange(max(1, files.count()), "path")
    return warc.normalise(listed, run_dir(spark, "members"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark items in documents, with up to 5 % edits."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and acceptance of each document."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, keep_id): each document that is near another, and the smallest of its group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, keep_id) of documents with the same bytes."""
    return exact_dedup.duplicate_pairs(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.train(pages))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal identifiers and secrets in documents."""
    return pii.identifiers(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found toxic, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).where("toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_normalise, op2_decontamination, op3_license_scan, op4_language_id, op5_simhash_near_dedup, op6_exact_dedup, op7_packing, op8_html_extract, op9_pii, op10_toxicity)}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id, keep_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth
            FROM documents WHERE text IS NOT NULL) AS numbered
        WHERE nth > 1""",
}
