"""Exact deduplication: group by 128-bit content hash, keep the smallest id,
compare bytes inside groups.

Only (hash) crosses the network for the first pass; texts are shuffled only for
rows whose hash occurs more than once, and there grouping by the text itself
separates collisions. Aggregations combine on the map side, so a text copied
millions of times is no hot key.

Defined results:

* a null text has no content: such rows are nobody's copies and all stay;
* an empty text is a text like any other, and so is a very long one, which is
  hashed and compared whole;
* a null doc_id is larger than any id; among equal ids (repeated rows) one row
  stays;
* an empty table gives an empty result; further columns are carried along, with
  whatever names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import cut, fresh, sized


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def repeated_hashes(docs: DataFrame, h: str) -> tuple[DataFrame, int]:
    """The content hashes that more than one row has, and their number."""
    many = cut(
        docs.where(F.col("text").isNotNull()).groupBy(content_hash(F.col("text")).alias(h)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(h)
    )
    return many, many.count()


def duplicate_pairs(docs: DataFrame) -> DataFrame:
    """A row (doc_id, keep_id) for each row that exact_dedup drops.

    keep_id is the smallest id with the same bytes. A repeated row of the kept
    id appears with doc_id = keep_id.
    """
    many, n = repeated_hashes(docs, "h")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("h", content_hash(F.col("text"))).join(sized(many, n), "h", "left_semi")
    # one row for each distinct (bytes, id); the second grouping needs no new shuffle of texts beyond the first's result
    ids = rows.groupBy("h", "text", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    kept = ids.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"))
    return (
        ids.join(kept, ["h", "text"])
        .withColumn("c", F.col("c") - F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")), 1).otherwise(0))
        .where("c > 0")
        .select("doc_id", "keep_id", F.explode(F.array_repeat(F.lit(1), F.col("c").cast("int"))).alias("one"))
        .select("doc_id", "keep_id")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs without exact copies, with the columns of docs."""
    h, row, rank = fresh(docs, "h", "row", "rank")
    many, n = repeated_hashes(docs, h)
    many = sized(many, n)
    hashed = docs.withColumn(h, content_hash(docs["text"]))
    single = hashed.join(many, h, "left_anti").select(*[hashed[c] for c in docs.columns])
    first = (
        hashed.join(many, h, "left_semi")
        .select(h, F.col("text"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i")).alias(rank), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(row))
        .groupBy(h, "text")
        .agg(F.min_by(row, rank).alias(row))
    )
    return single.unionByName(first.select(*[F.col("text") if c == "text" else F.col(row)[c].alias(c) for c in docs.columns]))
