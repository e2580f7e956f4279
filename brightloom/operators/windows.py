"""Functions over range windows of points (keys..., t, v), one row for each key and window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.ieee import INF, NAN, lit
from brightloom.plans.grid import Grid, buckets, ceil_div, fan_out, fan_out_buckets, floor_div


def largest(v: Column) -> Column:
    """The maximum, NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def quantile(v: Column, q: float) -> Column:
    """Interpolated between neighbours; beyond 0 and 1 infinite."""
    if q != q:
        return F.max(lit(NAN))
    if q < 0 or q > 1:
        return F.max(lit(-INF if q < 0 else INF))
    return F.percentile(v, F.lit(q))


#: Partial columns and how to finish them, for functions that partial results determine.
DECOMPOSED = {
    "count": lambda v: ({"n": F.count(F.lit(1))}, F.sum("n").cast("double")),
    "sum": lambda v: ({"s": F.sum(v)}, F.sum("s")),
    "avg": lambda v: ({"s": F.sum(v), "n": F.count(v)}, F.sum("s") / F.sum("n")),
    "min": lambda v: ({"m": F.min(v)}, F.min("m")),
    "max": lambda v: ({"m": largest(v)}, largest(F.col("m"))),
    "first": lambda v: ({"f": F.min_by(v, "t"), "ft": F.min("t")}, F.min_by("f", "ft")),
    "last": lambda v: ({"l": F.max_by(v, "t"), "lt": F.max("t")}, F.max_by("l", "lt")),
    "present": lambda v: ({"n": F.count(F.lit(1))}, F.max(lit(1.0))),
}
DIRECT = {
    "count": lambda v: F.count(F.lit(1)).cast("double"),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": largest,
    "first": lambda v: F.min_by(v, "t"),
    "last": lambda v: F.max_by(v, "t"),
    "present": lambda v: F.max(lit(1.0)),
    "stddev": F.stddev_pop,
    "stdvar": F.var_pop,
}


COUNTER = frozenset(("rate", "increase"))


def over_time(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, function: str) -> DataFrame:
    """A simple aggregate of each window: (keys..., k, v).

    Where the window is several whole steps, points are first reduced to one
    partial row for each step, and only those are fanned out.
    """
    v = F.col("v")
    bucketed = buckets(points, grid, window) if function in DECOMPOSED else None
    if bucketed is not None:
        partial, final = DECOMPOSED[function](v)
        reduced = bucketed.groupBy(*keys, "b").agg(*[c.alias(n) for n, c in partial.items()])
        return fan_out_buckets(reduced, grid, window).groupBy(*keys, "k").agg(final.alias("v"))
    return fan_out(points, grid, window).groupBy(*keys, "k").agg(DIRECT[function](v).alias("v"))


def quantile_over_time(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, q: float, nearest: bool = False) -> DataFrame:
    """Interpolated, or the element of the nearest rank."""
    how = F.expr(f"percentile_disc({q!r}) WITHIN GROUP (ORDER BY v)") if nearest else quantile(F.col("v"), q)
    return fan_out(points, grid, window).groupBy(*keys, "k").agg(how.alias("v"))


_first, _last = (lambda a, n: F.element_at(a, 1)[n]), (lambda a, n: F.element_at(a, -1)[n])
_total = lambda a, n: F.aggregate(a, F.lit(0).cast("bigint") if n == "n" else lit(0.0), lambda s, x: s + x[n])

#: What a run of neighbouring points comes to, and what a window of such runs does: (of points, of an array of runs in time order).
STATE = {
    "n": (lambda: F.count(F.lit(1)), _total),
    "t0": (lambda: F.min("t"), _first),
    "t1": (lambda: F.max("t"), _last),
    "v0": (lambda: F.min_by("v", "t"), _first),
    "v1": (lambda: F.max_by("v", "t"), _last),
    "pv": (lambda: F.max_by("pv", "t"), _last),
    "pt": (lambda: F.max_by("pt", "t"), _last),
    "marks": (lambda: F.sum("mark"), _total),
    "mark0": (lambda: F.min_by("mark", "t"), _first),
}


def runs(reduced: DataFrame, keys: Sequence[str], grid: Grid, window: int) -> DataFrame:
    """(keys..., k, runs): the steps of each window, in time order, from one row (keys..., b, ...) for each step.

    A step makes the windows in which it is the last, so that no window is put
    together from rows that lie apart: the rows of a task are sorted once, before
    they are fanned out, and never grouped or sorted after it.
    """
    wide = window // grid.step
    own = Window.partitionBy(*keys).orderBy("b")
    held = F.collect_list(F.struct("b", *[c for c in reduced.columns if c not in keys and c != "b"])).over(own.rangeBetween(1 - wide, 0))
    last = F.least(F.col("b") + (wide - 1), F.lit(grid.last), F.lead("b").over(own) - 1)
    found = reduced.select(*keys, F.greatest(F.col("b"), F.lit(0)).alias("lo"), last.alias("hi"), held.alias("held")).where("lo <= hi")
    found = found.select(*keys, "held", F.explode(F.sequence("lo", "hi")).alias("k"))
    return found.select(*keys, "k", F.filter("held", lambda x: x["b"] > F.col("k") - wide).alias("runs"))


def states(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, names: Sequence[str]) -> DataFrame:
    """(keys..., k, names...): STATE of each window.

    Where the window is several whole steps, points are first reduced to one row
    for each step.
    """
    bucketed = buckets(points, grid, window)
    if bucketed is None:
        return fan_out(points, grid, window).groupBy(*keys, "k").agg(*[STATE[n][0]().alias(n) for n in names])
    reduced = bucketed.groupBy(*keys, "b").agg(*[STATE[n][0]().alias(n) for n in names])
    return runs(reduced, keys, grid, window).select(*keys, "k", *[STATE[n][1](F.col("runs"), n).alias(n) for n in names])


def extrapolated(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, function: str, unit: int) -> DataFrame:
    """rate, increase and delta of each series: the change between the
    first and last point of a window, extrapolated to the window.

    unit: time units in a second.
    """
    counter = function in COUNTER
    names = ["n", "t0", "t1", "v0", "v1"]
    change = F.col("v1") - F.col("v0")
    if counter:  # what the counter fell to at each reset; a fall onto the window's first point happened before it
        before = F.lag("v").over(Window.partitionBy(*keys).orderBy("t"))
        points = points.withColumn("mark", F.when(F.col("v") < before, before).otherwise(lit(0.0)))
        names += ["marks", "mark0"]
        change = change + (F.col("marks") - F.col("mark0"))
    g = states(points, keys, grid, window, names)
    g = g.where("n >= 2 and t1 > t0")
    span = ((F.col("t1") - F.col("t0")) / unit).cast("double")
    gap = span / (F.col("n") - 1)
    end = grid.time(F.col("k"))
    g = g.withColumn("change", change).withColumn("span", span).withColumn("gap", gap)
    to_start = ((F.col("t0") - (end - window)) / unit).cast("double")
    to_end = ((end - F.col("t1")) / unit).cast("double")
    g = g.withColumn("a", F.when(to_start >= F.col("gap") * 1.1, F.col("gap") / 2).otherwise(to_start)).withColumn("z", F.when(to_end >= F.col("gap") * 1.1, F.col("gap") / 2).otherwise(to_end))
    if counter:  # a counter was not below zero before the window
        zero = F.col("span") * (F.col("v0") / F.col("change"))
        g = g.withColumn("a", F.when((F.col("change") > 0) & (F.col("v0") >= 0) & (zero < F.col("a")), zero).otherwise(F.col("a")))
    v = F.col("change") * ((F.col("span") + F.col("a") + F.col("z")) / F.col("span"))
    if function == "rate":
        v = v / (window / unit)
    return g.select(*keys, "k", v.alias("v"))


def instantaneous(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, function: str, unit: int) -> DataFrame:
    """irate and idelta: of the last two points of each window."""
    own = Window.partitionBy(*keys).orderBy("t")
    paired = points.withColumn("pv", F.lag("v").over(own)).withColumn("pt", F.lag("t").over(own)).withColumn("nt", F.lead("t").over(own)).withColumnsRenamed({"v": "v1", "t": "t1"})
    at, after = F.col("t1"), ceil_div(F.col("nt") - grid.start, grid.step) - 1
    low = F.greatest(F.lit(0).cast("bigint"), ceil_div(at - grid.start, grid.step)).cast("int")
    high = F.least(F.lit(grid.last).cast("bigint"), floor_div(at + (window - 1 - grid.start), grid.step), after).cast("int")
    g = paired.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")  # the windows of which a point is the last
    g = g.where(F.col("pt") > grid.time(F.col("k")) - window)
    change = F.col("v1") - F.col("pv")
    if function == "irate":
        change = F.when(F.col("v1") < F.col("pv"), F.col("v1")).otherwise(change) / ((F.col("t1") - F.col("pt")) / unit)
    return g.select(*keys, "k", change.alias("v"))


def flips(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, function: str) -> DataFrame:
    """resets and changes between neighbouring points of each window."""
    own = Window.partitionBy(*keys).orderBy("t")
    before = F.lag("v").over(own)
    both_nan = F.isnan("v") & F.isnan(before)
    flip = (F.col("v") < before) & ~F.isnan(before) & ~F.isnan("v") if function == "resets" else (F.col("v") != before) & ~both_nan
    flagged = points.withColumn("mark", F.coalesce(flip, F.lit(False)).cast("double"))
    return states(flagged, keys, grid, window, ["marks", "mark0", "t0"]).select(*keys, "k", (F.col("marks") - F.col("mark0")).alias("v"))


def regression(points: DataFrame, keys: Sequence[str], grid: Grid, window: int, unit: int, ahead: float | None = None) -> DataFrame:
    """Slope of the least-squares line, or its value `ahead` seconds after the window."""
    bucketed = buckets(points, grid, window)
    if bucketed is None:
        fanned = fan_out(points, grid, window).withColumn("x", (F.col("t") - grid.time(F.col("k"))) / unit)
        g = fanned.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("level"))
    else:  # moments of each step about its own means, with times from its end
        x = bucketed.withColumn("x", (F.col("t") - grid.time(F.col("b"))) / unit)
        reduced = x.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.regr_count("v", "x").cast("double").alias("c"), F.regr_avgx("v", "x").alias("mx"), F.regr_avgy("v", "x").alias("mv"), F.regr_sxx("v", "x").alias("sxx"), F.regr_sxy("v", "x").alias("sxy"))
        g = runs(reduced, keys, grid, window).where((F.size("runs") > 1) | (F.col("runs")[0]["n"] > 1))

        def joined(m: Column, y: Column) -> Column:
            """The moments of two sets of points from those of each."""
            c, dv = m["c"] + y["c"], y["mv"] - m["av"]
            dx = y["mx"] + (y["b"] - F.col("k")) * lit(grid.step / unit) - m["ax"]
            share, both = y["c"] / c, m["c"] * y["c"] / c
            return F.struct(c.alias("c"), (m["ax"] + dx * share).alias("ax"), (m["av"] + dv * share).alias("av"), (m["xx"] + y["sxx"] + dx * dx * both).alias("xx"), (m["xy"] + y["sxy"] + dx * dv * both).alias("xy"))

        none = F.struct(*[lit(0.0).alias(n) for n in ("c", "ax", "av", "xx", "xy")])
        g = g.select(*keys, "k", F.aggregate(F.filter("runs", lambda y: y["c"] > 0), none, joined).alias("m")).where("m.xx > 0")  # points of one time have no slope
        slope = F.col("m.xy") / F.col("m.xx")
        v = slope if ahead is None else F.col("m.av") + slope * (ahead - F.col("m.ax"))
        return g.select(*keys, "k", v.alias("v"))
    v = F.col("slope") if ahead is None else F.col("level") + F.col("slope") * ahead
    return g.where("n >= 2 and slope is not null").select(*keys, "k", v.alias("v"))


def latest(points: DataFrame, keys: Sequence[str], grid: Grid, lookback: int, keep_time: bool = False) -> DataFrame:
    """The newest point of each window, unless it marks the series as stale."""
    seen = {"v": F.max_by("v", "t"), "is_stale": F.max_by("is_stale", "t"), "t": F.max("t")}
    bucketed = buckets(points, grid, lookback)
    if bucketed is not None:
        reduced = bucketed.groupBy(*keys, "b").agg(*[c.alias(n) for n, c in seen.items()])
        fanned = fan_out_buckets(reduced, grid, lookback)
    else:
        fanned = fan_out(points, grid, lookback)
    found = fanned.groupBy(*keys, "k").agg(*[c.alias(n) for n, c in seen.items()]).where("not is_stale")
    return found.select(*keys, "k", "v", *(["t"] if keep_time else []))
