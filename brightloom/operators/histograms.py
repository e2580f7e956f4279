"""Native histograms: exponential buckets held as spans, in the struct of the histograms table.

Bucket i of schema s ends at base^i with base = 2^(2^-s); buckets are absolute
counts, listed along spans of consecutive indexes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTOGRAM = "struct<schema:int,sum:double,count:double,zero_threshold:double,zero_count:double,pos_spans:array<struct<offset:int,length:int>>,pos_buckets:array<double>,neg_spans:array<struct<offset:int,length:int>>,neg_buckets:array<double>>"

_FIELDS = ("schema", "sum", "count", "zero_threshold", "zero_count", "pos_spans", "pos_buckets", "neg_spans", "neg_buckets")


def count(h: str) -> Column:
    return F.col(h)["count"]


def total(h: str) -> Column:
    return F.col(h)["sum"]


def average(h: str) -> Column:
    return F.try_divide(total(h), count(h))


def indexes(spans: Iterable) -> list[int]:
    """The bucket indexes along spans: each span's offset counts from the end of the last."""
    out, at = [], 0
    for s in spans:
        at += s["offset"]
        out += range(at, at + s["length"])
        at += s["length"]
    return out


def bounds(h: dict) -> list[tuple[float, float, float]]:
    """(lower, upper, count) of the buckets in ascending order, the zero bucket included."""
    base = 2.0 ** (2.0 ** -h["schema"])
    out = [(-(base**i), -(base ** (i - 1)), c) for i, c in zip(indexes(h["neg_spans"]), h["neg_buckets"])][::-1]
    if h["zero_count"]:
        low = -h["zero_threshold"] if out else 0.0
        positive = any(h["pos_buckets"])
        out.append((low, h["zero_threshold"] if positive or not out else 0.0, h["zero_count"]))
    return out + [(base ** (i - 1), base**i, c) for i, c in zip(indexes(h["pos_spans"]), h["pos_buckets"])]


def quantile_of(h: dict | None, q: float) -> float:
    """Exponential interpolation inside a bucket, linear in the zero bucket."""
    if h is None or not h["count"] or q != q:
        return math.nan
    if q < 0 or q > 1:
        return -math.inf if q < 0 else math.inf
    rank, seen, found = q * h["count"], 0.0, bounds(h)
    for low, high, c in found:
        if c and seen + c >= rank:
            share = (rank - seen) / c
            if low * high <= 0:
                return low + (high - low) * share
            if high > 0:
                return 2 ** (math.log2(low) + (math.log2(high) - math.log2(low)) * share)
            return -(2 ** (math.log2(-low) + (math.log2(-high) - math.log2(-low)) * share))
        seen += c
    return found[-1][1] if found else math.nan


def fraction_of(h: dict | None, low: float, high: float) -> float:
    """The share of observations between two values."""
    if h is None or not h["count"] or low != low or high != high:
        return math.nan
    if low >= high:
        return 0.0

    def below(x: float) -> float:
        seen = 0.0
        for a, b, c in bounds(h):
            if x >= b:
                seen += c
            elif x > a:
                share = (x - a) / (b - a) if a * b <= 0 else (math.log2(abs(x)) - math.log2(abs(a))) / (math.log2(abs(b)) - math.log2(abs(a)))
                return seen + c * share
            else:
                return seen
        return seen

    return (below(high) - below(low)) / h["count"]


def variance_of(h: dict | None) -> float:
    """Population variance, a bucket's observations taken at its geometric middle."""
    if h is None or not h["count"]:
        return math.nan
    mean = h["sum"] / h["count"]
    middle = lambda a, b: 0.0 if a * b <= 0 else math.copysign(math.sqrt(a * b), b)
    return sum(c * (middle(a, b) - mean) ** 2 for a, b, c in bounds(h)) / h["count"]


def counts_by_index(h: dict, schema: int) -> tuple[dict[int, float], dict[int, float]]:
    """Positive and negative buckets at a resolution that is not finer than the histogram's own."""
    out = []
    for spans, buckets in (("pos_spans", "pos_buckets"), ("neg_spans", "neg_buckets")):
        found: dict[int, float] = {}
        for i, c in zip(indexes(h[spans]), h[buckets]):
            i = -(-i >> (h["schema"] - schema))  # bucket i ends at base^i; wider ones end at every second, fourth ... bound
            found[i] = found.get(i, 0.0) + c
        out.append(found)
    return out[0], out[1]


def listed(schema: int, total: float, n: float, threshold: float, zeros: float, positive: dict[int, float], negative: dict[int, float]) -> dict:
    """A histogram of these buckets, each a span of its own."""

    def spans(found: dict[int, float]) -> list[dict]:
        at, out = 0, []
        for i in sorted(found):
            out.append({"offset": i - at, "length": 1})
            at = i + 1
        return out

    return {"schema": schema, "sum": total, "count": n, "zero_threshold": threshold, "zero_count": zeros, "pos_spans": spans(positive), "pos_buckets": [positive[i] for i in sorted(positive)], "neg_spans": spans(negative), "neg_buckets": [negative[i] for i in sorted(negative)]}


def weighted(parts: list[tuple[dict, float]]) -> dict | None:
    """The sum of histograms times weights, at the least resolution among them."""
    parts = [(h, w) for h, w in parts if h is not None]
    if not parts:
        return None
    schema = min(h["schema"] for h, _ in parts)
    sides: tuple[dict[int, float], dict[int, float]] = {}, {}
    for h, w in parts:
        for side, found in zip(sides, counts_by_index(h, schema)):
            for i, c in found.items():
                side[i] = side.get(i, 0.0) + w * c
    total = lambda name: float(sum(w * h[name] for h, w in parts))
    return listed(schema, total("sum"), total("count"), max(h["zero_threshold"] for h, _ in parts), total("zero_count"), *sides)


def increase_of(points: list[tuple[int, dict]], start: int, end: int, unit: int, per_second: bool, counter: bool) -> dict | None:
    """The change of a histogram over a window (start, end], extrapolated to it; counters begin anew where a count falls."""
    points = sorted(points, key=lambda p: p[0])
    if len(points) < 2 or points[-1][0] == points[0][0]:
        return None
    parts = [(points[-1][1], 1.0), (points[0][1], -1.0)]
    if counter:
        parts += [(a, 1.0) for (_, a), (_, b) in zip(points, points[1:]) if b["count"] < a["count"]]
    span = (points[-1][0] - points[0][0]) / unit
    gap = span / (len(points) - 1)
    edges = [(points[0][0] - start) / unit, (end - points[-1][0]) / unit]
    factor = (span + sum(gap / 2 if x >= gap * 1.1 else x for x in edges)) / span
    if per_second:
        factor /= (end - start) / unit
    change = weighted(parts)
    return weighted([(change, factor)])


def _dicts(h: pd.DataFrame) -> list[dict]:
    return h.to_dict("records")


def _column(f: object) -> object:
    @F.pandas_udf(T.DoubleType())
    def of(h: pd.DataFrame) -> pd.Series:
        return pd.Series([f(x) for x in _dicts(h)], dtype="float64")

    return of


def quantile(h: str, q: float) -> Column:
    return _column(lambda x: quantile_of(x, q))(F.col(h))


def fraction(h: str, low: float, high: float) -> Column:
    return _column(lambda x: fraction_of(x, low, high))(F.col(h))


def variance(h: str) -> Column:
    return _column(variance_of)(F.col(h))


def deviation(h: str) -> Column:
    return F.sqrt(variance(h))


def _plain(h: object) -> dict:
    """A histogram as workers get it, as plain lists and dictionaries."""
    h = h.asDict(recursive=True) if hasattr(h, "asDict") else dict(h)
    return {k: list(x) if k.endswith(("spans", "buckets")) and x is not None else x for k, x in h.items()}


def merged(hs: Column, average: bool = False) -> Column:
    """The sum (or mean) of an array of histograms."""

    @F.pandas_udf(HISTOGRAM)
    def of(batch: pd.Series) -> pd.DataFrame:
        rows = [weighted([(_plain(h), 1.0 / len(a) if average else 1.0) for h in a]) or {} for a in batch]
        return pd.DataFrame(rows, columns=list(_FIELDS))

    return of(hs)


def increased(points: Column, end: Column, window: int, unit: int, per_second: bool, counter: bool) -> Column:
    """increase_of an array of (t, h) in the window before `end`; null where there are fewer than two."""

    @F.pandas_udf(HISTOGRAM)
    def of(batch: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for a, e in zip(batch, ends):
            own = [(p["t"], _plain(p["v"])) for p in a]
            rows.append(increase_of(own, e - window, e, unit, per_second, counter) or {})
        return pd.DataFrame(rows, columns=list(_FIELDS))

    return of(points, end)


def latest_version(table: DataFrame) -> DataFrame:
    """One histogram for each series and time: that of the highest version."""
    return table.groupBy("team_id", "id", "ts_ms").agg(F.max_by("h", "version").alias("h"))


def from_values(df: DataFrame, keys: Sequence[str], schema: int = 3, zero_threshold: float = 1e-9) -> DataFrame:
    """(keys..., h): histograms of the values v of each group.

    Values go to buckets in Spark; a group's buckets are then listed as spans of one.
    """
    v = F.col("v")
    index = F.ceil(F.log2(F.abs(v)) * float(2**schema)).cast("int")
    sign = F.when(F.abs(v) <= zero_threshold, 0).otherwise(F.signum(v).cast("int"))
    buckets = df.where("v is not null and not isnan(v)").groupBy(*keys, sign.alias("sign"), F.when(sign != 0, index).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("v").alias("s"))
    pick = lambda side: F.sort_array(F.collect_list(F.when(F.col("sign") == side, F.struct("i", "c"))))
    g = buckets.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.coalesce(F.sum(F.when(F.col("sign") == 0, F.col("c"))), F.lit(0.0)).alias("z"), pick(1).alias("p"), pick(-1).alias("m"))

    def spans(a: str) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col(a), k - 1)["i"] + 1)
        return F.transform(F.col(a), lambda x, k: F.struct((x["i"] - before(k)).cast("int").alias("offset"), F.lit(1).alias("length")))

    counts = lambda a: F.transform(F.col(a), lambda x: x["c"])
    h = F.struct(F.lit(schema).alias("schema"), F.col("s").alias("sum"), F.col("n").alias("count"), F.lit(zero_threshold).alias("zero_threshold"), F.col("z").alias("zero_count"), spans("p").alias("pos_spans"), counts("p").alias("pos_buckets"), spans("m").alias("neg_spans"), counts("m").alias("neg_buckets"))
    return g.select(*keys, h.alias("h"))
