"""Metadata: label names and values, series, families, exemplars, and the log equivalents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions import labels as L
from brightloom.lang import logql as logql_ast
from brightloom.lang import promql as promql_ast
from brightloom.lang.tokens import QueryError
from brightloom.sources.stores import LogStore, Matchers

CORE_LOG_LABELS = ("service_name", "service.name", "level", "severity_text", "detected_level", "trace_id", "span_id")
BUILD_INFO = {"version": "0.1.0", "revision": "", "branch": "", "buildUser": "", "buildDate": "", "goVersion": ""}
INDEX_STATS = {"streams": 0, "chunks": 0, "entries": 0, "bytes": 0}
RULES: dict = {"groups": []}
ALERTS: dict = {"alerts": []}


def matchers_of(selectors: Sequence[str]) -> list[Matchers]:
    out = []
    for text in selectors:
        e = promql_ast.parse(text)
        if not isinstance(e, promql_ast.Selector) or e.range_ns is not None:
            raise QueryError("match[] takes instant selectors")
        out.append(e.matchers)
    return out or [[]]


def series(store: object, selectors: Sequence[str] = (), start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """(labels) of the series that meet any selector and have samples in the range, in label order."""
    found = met(store, selectors, start_ms, end_ms).withColumn("key", L.key(F.col("labels"))).dropDuplicates(["key"]).orderBy("key").select("labels")
    return found if limit is None else found.limit(limit)


def met(store: object, selectors: Sequence[str], start_ms: int | None, end_ms: int | None) -> DataFrame:
    """(labels) of the series, in no order; those that several selectors meet are repeated."""
    found = None
    for m in matchers_of(selectors):
        part = store.series(m, start_ms, end_ms).select("labels")
        found = part if found is None else found.unionByName(part)
    return found


def label_names(store: object, selectors: Sequence[str] = (), start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """(name): the label names in use, __name__ always among them."""
    names = met(store, selectors, start_ms, end_ms).select(F.explode(F.map_keys("labels")).alias("name"))
    names = names.unionByName(store.spark.range(1).select(F.lit(L.NAME).alias("name"))).distinct().orderBy("name")
    return names if limit is None else names.limit(limit)


def label_values(store: object, name: str, selectors: Sequence[str] = (), start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """(value): the values of a label."""
    values = met(store, selectors, start_ms, end_ms).select(F.col("labels")[name].alias("value")).where("value <> ''").distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def families(store: object, metric: str | None = None, limit: int | None = None) -> DataFrame:
    """(family, type, unit, help), the latest of each family."""
    df = store.metadata if metric is None else store.metadata.where(F.col("family") == metric)
    latest = df.groupBy("family").agg(F.max_by(F.struct("type", "unit", "help"), "updated_at_ms").alias("m")).select("family", "m.*").orderBy("family")
    return latest if limit is None else latest.limit(limit)


def exemplars(store: object, query: str, start_ms: int, end_ms: int) -> DataFrame:
    """(labels, exemplar_labels, ts_ms, v) of all series that any selector of the query meets."""
    found = None
    for s in promql_ast.selectors(promql_ast.parse(query)):
        part = store.series(s.matchers)
        found = part if found is None else found.unionByName(part)
    found = found.dropDuplicates(["id"])
    own = store.exemplars.where(F.col("ts_ms").between(start_ms, end_ms)).groupBy("id", "ts_ms").agg(F.any_value(F.struct("v", "labels")).alias("e"))
    return own.join(found, "id").select("labels", F.col("e.labels").alias("exemplar_labels"), "ts_ms", F.col("e.v").alias("v"))


def _log_matchers(selectors: Sequence[str]) -> list[Matchers]:
    out = []
    for text in selectors:
        e = logql_ast.parse(text)
        if not isinstance(e, logql_ast.LogQuery):
            raise QueryError("match[] takes selectors")
        out.append(e.matchers)
    return out or [[]]


def log_series(store: LogStore, selectors: Sequence[str], start_ns: int, end_ns: int) -> DataFrame:
    """(labels) of the streams with rows in the range."""
    found = None
    for m in _log_matchers(selectors):
        part = store.select(m, start_ns, end_ns).select(L.key(F.col("stream")).alias("key")).distinct()
        found = part if found is None else found.unionByName(part)
    return found.distinct().orderBy("key").select(L.from_key(F.col("key")).alias("labels"))


def log_labels(store: LogStore, start_ns: int, end_ns: int) -> DataFrame:
    """(name): the core names and those in use."""
    used = store.select([], start_ns, end_ns).select(F.explode(F.array_distinct(F.concat(F.map_keys("stream"), F.map_keys("resource")))).alias("name")).distinct()
    core = store.spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in CORE_LOG_LABELS])).alias("name"))
    return used.unionByName(core).distinct().orderBy("name")


def log_label_values(store: LogStore, name: str, start_ns: int, end_ns: int, selectors: Sequence[str] = ()) -> DataFrame:
    """(value): the values of a label under any of its accepted names."""
    found = None
    for m in _log_matchers(selectors):
        value = F.coalesce(F.nullif(L.aliased(F.col("stream"), name), F.lit("")), F.col("resource")[name])
        part = store.select(m, start_ns, end_ns).select(value.alias("value")).where("value <> ''").distinct()
        found = part if found is None else found.unionByName(part)
    return found.distinct().orderBy("value")
