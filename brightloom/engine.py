"""The engine: queries in, lazy frames out; results shaped for an API at the edge."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.lang import logql as logql_ast
from brightloom.lang import promql as promql_ast
from brightloom.lang.tokens import QueryError
from brightloom.plans import logql, promql
from brightloom.sources import wire

MAX_POINTS = 11_000
INSTANT_LOG_LOOKBACK_NS = 6 * 3600 * 1_000_000_000


def promql_range(store: object, query: str, start_ms: int, end_ms: int, step_ms: int, lookback_ms: int = promql.LOOKBACK_MS) -> DataFrame:
    """(labels, ts, v) of a PromQL query at start, start + step, ..."""
    if step_ms <= 0 or end_ms < start_ms:
        raise QueryError("a range needs a positive step and an end after its start")
    if (end_ms - start_ms) // step_ms > MAX_POINTS:
        raise QueryError("too many steps")
    e = promql_ast.parse(query)
    if promql_ast.kind(e) not in "SV":
        raise QueryError("a range query takes a scalar or an instant vector")
    return promql.Compiler(store, start_ms, end_ms, step_ms, lookback_ms).compile(e)


def promql_instant(store: object, query: str, at_ms: int, lookback_ms: int = promql.LOOKBACK_MS) -> DataFrame:
    """(labels, ts, v) of a PromQL query at one time; a range selector gives its points."""
    e = promql_ast.parse(query)
    c = promql.Compiler(store, at_ms, at_ms, 1, lookback_ms)
    if promql_ast.kind(e) == "R":
        points, at, span, _ = c.window(e, c.grid)
        inside = points.df.where((points.df["t"] > at.start - span) & (points.df["t"] <= at.start))
        return points.attach(inside).select("labels", inside["t"].alias("ts"), "v")
    if promql_ast.kind(e) == "T":
        raise QueryError("a string is no vector")
    return c.compile(e)


def logql_range(store: object, query: str, start_ns: int, end_ns: int, step_ns: int = 60_000_000_000, limit: int | None = 100, direction: str = "backward") -> DataFrame:
    """Log rows (labels, ts_ns, line), or the metric (labels, ts, v)."""
    e = logql_ast.parse(query)
    if isinstance(e, logql_ast.LogQuery):
        return logql.Compiler(store, start_ns, end_ns, max(1, end_ns - start_ns), instant=True).logs(e, limit, direction == "forward")
    return logql.Compiler(store, start_ns, end_ns, step_ns).compile(e)


def logql_instant(store: object, query: str, at_ns: int, limit: int | None = 100, direction: str = "backward") -> DataFrame:
    e = logql_ast.parse(query)
    if isinstance(e, logql_ast.LogQuery):
        return logql_range(store, query, at_ns - INSTANT_LOG_LOOKBACK_NS, at_ns, limit=limit, direction=direction)
    return logql.Compiler(store, at_ns, at_ns, 1, instant=True).compile(e)


def remote_read(store: object, start_ms: int, end_ms: int, matchers: list[tuple[str, str, str]]) -> DataFrame:
    """(labels, samples, histograms) of each series that matches, points in time order: a query of the read protocol."""
    points = store.points(matchers, start_ms, end_ms)
    df = points.df.groupBy(*points.keys).agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("ts"), "v"))).alias("samples"))
    native = store.native(matchers, start_ms, end_ms)
    if native is None:
        df = df.withColumn("histograms", F.lit(None).cast(f"array<struct<ts:bigint,h:{wire.H_DDL}>>"))
    else:
        held = native.df.groupBy(*native.keys).agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("ts"), F.col("v").alias("h"))), lambda a, b: F.sign(a["ts"] - b["ts"]).cast("int")).alias("histograms"))
        df = df.join(held, native.keys, "full")
    return points.attach(df).select("labels", "samples", "histograms")


def spelt(v: float) -> str:
    """A value as the API spells it: shortest fixed notation, NaN, +Inf, -Inf."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "+Inf" if v > 0 else "-Inf"
    text = repr(float(v))
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


def matrix_json(result: DataFrame) -> dict:
    """The API's matrix of a result; rows reach the driver here and nowhere else."""
    series: dict[str, dict] = {}
    for r in result.orderBy("ts").toLocalIterator():
        key = json.dumps(sorted(r["labels"].items()))
        series.setdefault(key, {"metric": dict(sorted(r["labels"].items())), "values": []})["values"].append([r["ts"] / 1000, spelt(r["v"])])
    return {"status": "success", "data": {"resultType": "matrix", "result": [series[k] for k in sorted(series)]}}


def vector_json(result: DataFrame) -> dict:
    rows = ({"metric": dict(sorted(r["labels"].items())), "value": [r["ts"] / 1000, spelt(r["v"])]} for r in result.toLocalIterator())
    return {"status": "success", "data": {"resultType": "vector", "result": list(rows)}}


def streams_json(result: DataFrame) -> dict:
    """The API's streams of log rows, label sets in the order of their first row."""
    streams: dict[str, dict] = {}
    for r in result.toLocalIterator():
        key = json.dumps(sorted(r["labels"].items()))
        streams.setdefault(key, {"stream": dict(sorted(r["labels"].items())), "values": []})["values"].append([str(r["ts_ns"]), r["line"]])
    return {"status": "success", "data": {"resultType": "streams", "result": list(streams.values())}}


def lines(result: DataFrame) -> Iterator[str]:
    for r in result.toLocalIterator():
        yield r["line"]


def parse_time_ms(text: str) -> int:
    """Seconds or RFC 3339, as milliseconds."""
    try:
        return round(float(text) * 1000)
    except ValueError:
        return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1000)


def parse_time_ns(text: str) -> int:
    """Whole numbers of more than 11 digits are nanoseconds; else as parse_time_ms."""
    if text.lstrip("-").isdigit() and len(text.lstrip("-")) > 11:
        return int(text)
    return parse_time_ms(text) * 1_000_000
