"""Operators on instant vectors (labels, ts, v): aggregation, top-k, matching, sets, labels, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import labels as L
from brightloom.functions.ieee import ARITHMETIC, COMPARE, INF, NAN, fixed, lit
from brightloom.operators.windows import largest, quantile


AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": largest, "count": lambda v: F.count(F.lit(1)).cast("double"), "group": lambda v: F.max(lit(1.0)), "stddev": F.stddev_pop, "stdvar": F.var_pop}


class MatchError(ValueError):
    """Vectors that cannot be matched."""


def grouped(vector: DataFrame, names: Sequence[str] | None, without: bool, agg: Column, name: str = "v") -> DataFrame:
    """An aggregate for each group and time; by some labels the grouping keys are plain strings."""
    if not without:
        names = sorted(set(names or []))
        keys = [F.nullif(L.value(F.col("labels"), n), F.lit("")).alias(f"g{i}") for i, n in enumerate(names)]
        found = vector.select("ts", "v", *keys).groupBy("ts", *[f"g{i}" for i in range(len(names))]).agg(agg.alias(name))
        return found.select(L.build([(n, F.col(f"g{i}")) for i, n in enumerate(names)]).alias("labels"), "ts", name)
    kept = L.without(F.col("labels"), [*(names or []), L.NAME])
    return vector.select(kept.alias("labels"), "ts", "v").groupBy("labels", "ts").agg(agg.alias(name)).select("labels", "ts", name)


def aggregate(vector: DataFrame, op: str, names: Sequence[str] | None, without: bool, param: object = None) -> DataFrame:
    if op in ("topk", "bottomk"):
        return top(vector, int(param), op == "bottomk", names, without)
    if op == "quantile":
        return grouped(vector, names, without, quantile(F.col("v"), float(param)))
    if op == "count_values":
        spelt = vector.withColumn("labels", L.put(F.col("labels"), str(param), fixed(F.col("v"))))
        if without:
            return grouped(spelt, [n for n in names or [] if n != param], True, AGGREGATES["count"](F.col("v")))
        return grouped(spelt, [*(names or []), str(param)], False, AGGREGATES["count"](F.col("v")))
    return grouped(vector, names, without, AGGREGATES[op](F.col("v")))


def top(vector: DataFrame, k: int, lowest: bool, names: Sequence[str] | None = None, without: bool = False) -> DataFrame:
    """The k highest or lowest of each time and group, whole labels kept; NaN last, ties by label set."""
    if k <= 0:
        return vector.where(F.lit(False))
    group = L.key(L.without(F.col("labels"), [*(names or []), L.NAME]) if without else L.only(F.col("labels"), names or []))
    order = [F.isnan(F.col("v")), F.col("v").asc() if lowest else F.col("v").desc(), L.key(F.col("labels"))]
    ranked = vector.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("ts", "group").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("labels", "ts", "v")


def match_labels(labels: Column, on: bool, names: Sequence[str] | None) -> Column:
    return L.only(labels, names or []) if on else L.without(labels, [*(names or []), L.NAME])


def binary(left: DataFrame, right: DataFrame, op: str, is_bool: bool, on: bool, names: Sequence[str] | None, group: str | None, include: Sequence[str], first_match: bool = False) -> DataFrame:
    """left op right, matched by labels at each time.

    first_match takes the first of several partners (in label order); else more
    than one partner on a side that should have one fails the query.
    """
    many, one = (right, left) if group == "right" else (left, right)
    many = many.select(F.col("labels").alias("ml"), F.col("ts").alias("ts"), F.col("v").alias("mv"), L.key(match_labels(F.col("labels"), on, names)).alias("key"))
    one = one.select(F.col("labels").alias("ol"), F.col("ts").alias("ts"), F.col("v").alias("ov"), L.key(match_labels(F.col("labels"), on, names)).alias("key"))
    if first_match:
        if group is None:
            one = one.withColumn("nth", F.row_number().over(Window.partitionBy("ts", "key").orderBy(L.key(F.col("ol"))))).where("nth = 1").drop("nth")
    else:
        one = _unique(one)
        if group is None:
            many = _unique(many)
    both = many.join(one, ["ts", "key"])
    lv, rv = (F.col("ov"), F.col("mv")) if group == "right" else (F.col("mv"), F.col("ov"))
    keeps_left = op in COMPARE and not is_bool
    labels = F.col("ml")
    if not keeps_left:
        labels = L.without(labels, [L.NAME])
    if group is None and not first_match:
        labels = L.only(labels, names or []) if on else L.without(labels, names or [])
    for n in include:
        labels = L.put(labels, n, L.value(F.col("ol"), n))
    if op in COMPARE:
        hit = COMPARE[op](lv, rv)
        if is_bool:
            return both.select(labels.alias("labels"), "ts", hit.cast("double").alias("v"))
        return both.where(hit).select(labels.alias("labels"), "ts", lv.alias("v"))
    return both.select(labels.alias("labels"), "ts", ARITHMETIC[op](lv, rv).alias("v"))


def _unique(side: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("ts", "key"))
    value = [c for c in side.columns if c in ("mv", "ov")][0]
    checked = F.when(n > 1, F.raise_error(F.lit("found duplicate series for the match group: many-to-many matching is not allowed"))).otherwise(F.col(value))
    return side.withColumn(value, checked.cast("double"))


def set_op(left: DataFrame, right: DataFrame, op: str, on: bool, names: Sequence[str] | None) -> DataFrame:
    keyed = lambda df: df.withColumn("key", L.key(match_labels(F.col("labels"), on, names)))
    left, right = keyed(left), keyed(right)
    keys = lambda df: df.select("ts", "key").distinct()
    if op == "and":
        out = left.join(keys(right), ["ts", "key"], "left_semi")
    elif op == "unless":
        out = left.join(keys(right), ["ts", "key"], "left_anti")
    else:
        out = left.select("labels", "ts", "v").unionByName(right.join(keys(left), ["ts", "key"], "left_anti").select("labels", "ts", "v"))
    return out.select("labels", "ts", "v")


def label_replace(vector: DataFrame, dst: str, replacement: str, src: str, pattern: str, anchored: bool) -> DataFrame:
    source = L.value(F.col("labels"), src)
    regex = L.anchored(pattern) if anchored else L.java_regex(pattern)
    java = "".join(c if not c.startswith("${") else "$" + c[2:-1] for c in _references(replacement))
    new = F.regexp_replace(source, regex, java) if anchored else F.regexp_replace(F.regexp_extract(source, regex, 0), regex, java)
    if anchored and pattern in (".*", "(.*)"):  # an empty match at the end would be replaced once more
        new = F.regexp_replace(source, f"^(?s:({pattern if pattern == '.*' else '.*'}))$", java)
    return vector.withColumn("labels", F.when(source.rlike(regex), L.put(F.col("labels"), dst, new)).otherwise(F.col("labels")))


def _references(text: str) -> list[str]:
    import re

    return re.findall(r"\$\{\w+\}|\$\w+|[^$]+|\$", text)


def label_join(vector: DataFrame, dst: str, separator: str, sources: Sequence[str]) -> DataFrame:
    return vector.withColumn("labels", L.put(F.col("labels"), dst, F.concat_ws(separator, *[L.value(F.col("labels"), s) for s in sources])))


def distinct_labels(vector: DataFrame) -> DataFrame:
    """Fails the query where two rows of a time have one label set."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ts", L.key(F.col("labels"))))
    return vector.withColumn("v", F.when(n > 1, F.raise_error(F.lit("vector cannot contain metrics with the same labelset"))).otherwise(F.col("v")).cast("double"))


def histogram_quantile(vector: DataFrame, q: float) -> DataFrame:
    """Quantile of classic histograms: cumulative buckets by their label le."""
    le = F.element_at(F.col("labels"), "le")
    bound = F.when(le.isin("+Inf", "Inf", "inf"), lit(INF)).otherwise(le.try_cast("double"))
    b = vector.select(L.without(F.col("labels"), ["le", L.NAME]).alias("labels"), "ts", bound.alias("le"), "v").where("le is not null")
    b = b.groupBy("labels", "ts", "le").agg(F.sum("v").alias("v")).withColumn("key", L.key(F.col("labels")))
    own = Window.partitionBy("key", "ts").orderBy("le")
    b = b.withColumn("c", F.max("v").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("pc", F.lag("c").over(own)).withColumn("ple", F.lag("le").over(own)).withColumn("total", F.max("c").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    b = b.withColumn("top", F.max("le").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("n", F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if q != q or q < 0 or q > 1:
        fixed_value = NAN if q != q else -INF if q < 0 else INF
        return b.groupBy("key", "ts").agg(F.first("labels").alias("labels")).select("labels", "ts", lit(fixed_value).alias("v"))
    rank = lit(q) * F.col("total")
    inside = F.col("c") >= rank
    g = b.groupBy("key", "ts").agg(F.min_by(F.struct("labels", "le", "c", "pc", "ple", "total", "top", "n"), F.struct(~inside, F.col("le"))).alias("b")).select("ts", "b.*")
    low = F.coalesce(F.col("ple"), F.when(F.col("le") > 0, lit(0.0)).otherwise(F.col("le")))
    below = F.coalesce(F.col("pc"), lit(0.0))
    inner = low + (F.col("le") - low) * ((lit(q) * F.col("total") - below) / F.nullif(F.col("c") - below, lit(0.0)))
    v = F.when((F.col("top") != INF) | (F.col("n") < 2) | (F.col("total") == 0) | F.isnan("total"), lit(NAN)).when(F.col("le") == INF, F.col("ple")).when(F.col("ple").isNull() & (F.col("le") <= 0), F.col("le")).otherwise(F.coalesce(inner, low))
    return g.select("labels", "ts", v.alias("v"))


def running_sum(vector: DataFrame) -> DataFrame:
    """The sum over the times so far; NaN counts as 0."""
    own = Window.partitionBy(L.key(F.col("labels"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return vector.select("labels", "ts", F.sum(F.when(F.isnan(F.col("v")), lit(0.0)).otherwise(F.col("v"))).over(own).alias("v"))
