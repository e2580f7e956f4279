"""PromQL trees as lazy DataFrame plans over a metric store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import ieee
from brightloom.functions import labels as L
from brightloom.functions.ieee import NAN, lit
from brightloom.lang import promql as ast
from brightloom.lang.tokens import QueryError
from brightloom.operators import histograms as H
from brightloom.operators import vectors as VO
from brightloom.operators import windows as W
from brightloom.plans.grid import Grid, fan_out
from brightloom.sources.stores import Points

UNIT = 1000  # the grid is in milliseconds
LOOKBACK_MS = 300_000


@dataclass
class Scalar:
    """A value for each time: a function of the time, or a frame (ts, v)."""

    of: Callable[[Column], Column] | None = None
    df: DataFrame | None = None
    constant: float | None = None

    @classmethod
    def number(cls, x: float) -> "Scalar":
        return cls(lambda _: lit(x), None, x)




MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": lambda v: _whole(v, F.ceil), "floor": lambda v: _whole(v, F.floor), "sgn": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)), "exp": F.exp, "sqrt": ieee.sqrt,
    "ln": lambda v: ieee.log(v), "log2": lambda v: ieee.log(v, 2), "log10": lambda v: ieee.log(v, 10), "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh,
    "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh, "deg": F.degrees, "rad": F.radians,
}


def _whole(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) >= 2**53), v).otherwise(f(v).cast("double"))


def _stamp(v: Column) -> Column:
    return F.timestamp_micros((v * 1_000_000).cast("bigint"))


CLOCK: dict[str, Callable[[Column], Column]] = {
    "minute": lambda v: F.pmod(F.floor(v / 60), F.lit(60)), "hour": lambda v: F.pmod(F.floor(v / 3600), F.lit(24)), "day_of_week": lambda v: F.pmod(F.floor(v / 86400) + 4, F.lit(7)),
    "day_of_month": lambda v: F.dayofmonth(_stamp(v)), "day_of_year": lambda v: F.dayofyear(_stamp(v)), "days_in_month": lambda v: F.dayofmonth(F.last_day(_stamp(v))), "month": lambda v: F.month(_stamp(v)), "year": lambda v: F.year(_stamp(v)),
}
SIMPLE = {f"{n}_over_time": n for n in ("avg", "min", "max", "sum", "count", "stddev", "stdvar", "last", "present")}


class Compiler:
    """Compiles one query; every method returns lazy frames (labels, ts, v)."""

    def __init__(self, store: object, start_ms: int, end_ms: int, step_ms: int, lookback_ms: int = LOOKBACK_MS) -> None:
        self.store, self.grid, self.lookback, self.spark = store, Grid(start_ms, end_ms, step_ms), lookback_ms, store.spark

    def compile(self, e: object) -> DataFrame:
        out = self.eval(simplified(e), self.grid)
        return self.spread(out, self.grid) if isinstance(out, Scalar) else out.select("labels", "ts", "v")

    def spread(self, s: Scalar, grid: Grid) -> DataFrame:
        """A scalar as a vector without labels."""
        if s.df is not None:
            return s.df.select(L.empty().alias("labels"), "ts", "v")
        ts = grid.time(F.col("k"))
        return grid.frame(self.spark).select(L.empty().alias("labels"), ts.alias("ts"), s.of(ts).alias("v"))

    def eval(self, e: object, grid: Grid) -> DataFrame | Scalar:
        match e:
            case ast.Num():
                return Scalar.number(e.value)
            case ast.Selector() if e.range_ns is None:
                return self.instant(e, grid)
            case ast.Negate():
                inner = self.eval(e.expr, grid)
                if isinstance(inner, Scalar):
                    return self.mapped(inner, lambda v: -v)
                return self.nameless(inner.withColumn("v", -F.col("v")))
            case ast.Aggregate():
                return self.aggregate(e, grid)
            case ast.Binary():
                return self.binary(e, grid)
            case ast.Call():
                return self.call(e, grid)
        raise QueryError("an expression of this type is no result")

    def nameless(self, vector: DataFrame) -> DataFrame:
        return vector.select(L.without(F.col("labels"), [L.NAME]).alias("labels"), "ts", "v")

    def mapped(self, s: Scalar, f: Callable[[Column], Column]) -> Scalar:
        if s.df is not None:
            return Scalar(None, s.df.withColumn("v", f(F.col("v"))))
        return Scalar(lambda ts: f(s.of(ts)))

    def with_scalar(self, vector: DataFrame, s: Scalar, name: str) -> tuple[DataFrame, Column]:
        """The vector with what it needs to use the scalar, and the scalar as a column."""
        if s.df is None:
            return vector, s.of(F.col("ts"))
        return vector.join(s.df.select("ts", F.col("v").alias(name)), "ts", "left"), F.coalesce(F.col(name), lit(NAN))

    # selectors

    def place(self, e: ast.Selector | ast.Subquery, grid: Grid) -> tuple[Grid, bool]:
        """The times at which a selector is read, and whether one time serves all."""
        offset = e.offset_ns // 1_000_000
        if e.at is None:
            return grid.shifted(-offset), False
        at = {"start": self.grid.start, "end": self.grid.end}.get(e.at) if isinstance(e.at, str) else round(e.at * 1000)
        return Grid(at - offset, at - offset, 1), True

    def window(self, e: ast.Selector | ast.Subquery, grid: Grid) -> tuple[Points, Grid, int, bool]:
        at, pinned = self.place(e, grid)
        span = e.range_ns // 1_000_000
        last = at.start + at.last * at.step
        if isinstance(e, ast.Selector):
            pts = self.store.points(e.matchers, at.start - span + 1, last)
            return Points(pts.df.where("not is_stale"), pts.keys, pts.attach), at, span, pinned
        step = grid.step if e.step_ns == -1 else e.step_ns // 1_000_000 if e.step_ns else max(1000, span // 10)
        first = ((at.start - span) // step + 1) * step
        inner = self.eval(e.expr, Grid(first, max(first, last // step * step), step))
        df = inner.select(L.key(F.col("labels")).alias("key"), F.col("ts").alias("t"), "v")
        return Points(df, ["key"], lambda x: x.withColumn("labels", L.from_key(F.col("key"))).drop("key")), at, span, pinned

    def finish(self, found: DataFrame, points: Points, grid: Grid, pinned: bool, keep_name: bool) -> DataFrame:
        if pinned:
            found = found.drop("k").crossJoin(F.broadcast(grid.frame(self.spark)))
        out = points.attach(found).withColumn("ts", grid.time(F.col("k")))
        labels = F.col("labels") if keep_name else L.without(F.col("labels"), [L.NAME])
        return out.select(labels.alias("labels"), "ts", "v", *(["t"] if "t" in out.columns else []))

    def instant(self, e: ast.Selector, grid: Grid, keep_time: bool = False) -> DataFrame:
        at, pinned = self.place(e, grid)
        points = self.store.points(e.matchers, at.start - self.lookback + 1, at.start + at.last * at.step)
        return self.finish(W.latest(points.df, points.keys, at, self.lookback, keep_time), points, grid, pinned, True)

    # functions

    def call(self, e: ast.Call, grid: Grid) -> DataFrame | Scalar:
        name, args = e.name, e.args
        if name == "time":
            return Scalar(lambda ts: (ts / 1000).cast("double"))
        if name == "pi":
            return Scalar.number(3.141592653589793)
        if name == "vector":
            return self.spread(self.eval(args[0], grid), grid)
        if name == "scalar":
            one = self.eval(args[0], grid).groupBy("ts").agg(F.when(F.count(F.lit(1)) == 1, F.max("v")).otherwise(lit(NAN)).alias("v"))
            ts = grid.frame(self.spark).select(grid.time(F.col("k")).alias("ts"))
            return Scalar(None, ts.join(one, "ts", "left").withColumn("v", F.coalesce("v", lit(NAN))))
        if name in ("absent", "absent_over_time"):
            return self.absent(args[0], grid, name == "absent_over_time")
        if ast.FUNCTIONS[name][0] in ("R", "RS", "SR"):
            return self.range_call(name, args, grid)
        if name in CLOCK:
            base = self.eval(args[0], grid) if args else self.spread(Scalar(lambda ts: (ts / 1000).cast("double")), grid)
            return self.nameless(base.withColumn("v", CLOCK[name](F.col("v")).cast("double")))
        if name == "timestamp":
            if isinstance(args[0], ast.Selector):
                return self.nameless(self.instant(args[0], grid, True).withColumn("v", (F.col("t") / 1000).cast("double")))
            return self.nameless(self.eval(args[0], grid).withColumn("v", (F.col("ts") / 1000).cast("double")))
        if name in ("sort", "sort_desc"):
            vector = self.eval(args[0], grid)
            return vector.orderBy(F.isnan("v"), F.col("v").desc() if name == "sort_desc" else F.col("v").asc(), L.key(F.col("labels")))
        if name == "label_replace":
            dst, replacement, src, regex = (a.value for a in args[1:])
            return VO.distinct_labels(VO.label_replace(self.eval(args[0], grid), dst, replacement, src, regex, anchored=True))
        if name == "label_join":
            return VO.distinct_labels(VO.label_join(self.eval(args[0], grid), args[1].value, args[2].value, [a.value for a in args[3:]]))
        if name == "running_sum":
            return self.nameless(VO.running_sum(self.eval(args[0], grid)))
        if name == "histogram_quantile":
            q = self.constant(args[0], grid)
            classic = VO.histogram_quantile(self.eval(args[1], grid), q)
            native = self.histograms(args[1], grid)
            return classic if native is None else classic.unionByName(native.select("labels", "ts", H.quantile("h", q).alias("v")))
        if name.startswith("histogram_"):
            native = self.histograms(args[-1], grid)
            if native is None:  # floats are no histograms
                return self.spread(Scalar.number(NAN), grid).where(F.lit(False))
            read = {"count": H.count, "sum": H.total, "avg": H.average, "stddev": H.deviation, "stdvar": H.variance}
            v = H.fraction("h", *(self.constant(a, grid) for a in args[:2])) if name == "histogram_fraction" else read[name.removeprefix("histogram_")]("h")
            return native.select("labels", "ts", F.coalesce(v, lit(NAN)).alias("v"))
        vector = self.nameless(self.eval(args[0], grid))
        if name in MATH:
            return vector.withColumn("v", MATH[name](F.col("v")))
        vector, bounds = vector, []
        for i, a in enumerate(args[1:]):
            vector, b = self.with_scalar(vector, self.eval(a, grid), f"s{i}")
            bounds.append(b)
        v = F.col("v")
        if name == "round":
            to = bounds[0] if bounds else lit(1.0)
            steps = F.try_divide(v, to)  # beyond 2^53 steps every double is a whole number of them
            v = F.when(F.isnan(v) | (F.abs(steps) >= 2**53), v).otherwise(F.coalesce(F.floor(steps + 0.5).cast("double") * to, lit(NAN)))
        else:
            low = bounds[0] if name != "clamp_max" else None
            high = bounds[-1] if name != "clamp_min" else None
            if name == "clamp":
                vector = vector.where(bounds[0] <= bounds[1])
            for b, f in ((low, F.greatest), (high, F.least)):
                if b is not None:
                    v = F.when(F.isnan(v) | F.isnan(b), lit(NAN)).otherwise(f(v, b))
        return vector.select("labels", "ts", v.alias("v"))

    def histograms(self, e: object, grid: Grid) -> DataFrame | None:
        """(labels, ts, h) of an expression over native histograms: a selector, rate, increase or delta of one, and sums, averages and multiples of these; None for any other or where the store has none."""
        match e:
            case ast.Selector() if e.range_ns is None:
                at, pinned = self.place(e, grid)
                points = self.store.native(e.matchers, at.start - self.lookback + 1, at.start + at.last * at.step)
                if points is None:
                    return None
                found = self.finish(W.latest(points.df, points.keys, at, self.lookback), points, grid, pinned, False)
            case ast.Call(name="rate" | "increase" | "delta") if isinstance(e.args[0], ast.Selector):
                s = e.args[0]
                at, pinned = self.place(s, grid)
                span = s.range_ns // 1_000_000
                points = self.store.native(s.matchers, at.start - span + 1, at.start + at.last * at.step)
                if points is None:
                    return None
                held = fan_out(points.df, at, span).groupBy(*points.keys, "k").agg(F.collect_list(F.struct("t", "v")).alias("points")).where("size(points) > 1")
                found = held.select(*points.keys, "k", H.increased(F.col("points"), at.time(F.col("k")), span, UNIT, e.name == "rate", e.name != "delta").alias("v")).where("v.count is not null")
                found = self.finish(found, points, grid, pinned, False)
            case ast.Aggregate(op="sum" | "avg"):
                inner = self.histograms(e.expr, grid)
                if inner is None:
                    return None
                held = VO.grouped(inner.withColumnRenamed("h", "v"), e.names, e.without, F.collect_list("v"))
                return held.select("labels", "ts", H.merged(F.col("v"), e.op == "avg").alias("h"))
            case ast.Binary(op="*" | "/"):
                vector, factor = (e.left, e.right) if not isinstance(e.left, ast.Num) else (e.right, e.left)
                inner = self.histograms(vector, grid) if isinstance(factor, ast.Num) and (e.op == "*" or factor is e.right) else None
                if inner is None:
                    return None
                f = lit(factor.value if e.op == "*" else 1 / factor.value if factor.value else NAN)
                scale = lambda name: F.transform(F.col(f"h.{name}"), lambda x: x * f)
                h = F.col("h").withField("count", F.col("h.count") * f).withField("sum", F.col("h.sum") * f).withField("zero_count", F.col("h.zero_count") * f)
                return inner.select("labels", "ts", h.withField("pos_buckets", scale("pos_buckets")).withField("neg_buckets", scale("neg_buckets")).alias("h"))
            case _:
                return None
        return found.select("labels", "ts", F.col("v").alias("h"))

    def constant(self, e: object, grid: Grid) -> float:
        s = self.eval(e, grid)
        if s.constant is None:
            raise QueryError("this parameter must be a number")
        return s.constant

    def range_call(self, name: str, args: list, grid: Grid) -> DataFrame:
        points, at, span, pinned = self.window(args[-1] if name == "quantile_over_time" else args[0], grid)
        df, keys = points.df, points.keys
        if name in ("rate", "increase", "delta"):
            found = W.extrapolated(df, keys, at, span, name, UNIT)
        elif name in ("irate", "idelta"):
            found = W.instantaneous(df, keys, at, span, name, UNIT)
        elif name in ("resets", "changes"):
            found = W.flips(df, keys, at, span, name)
        elif name in ("deriv", "predict_linear"):
            found = W.regression(df, keys, at, span, UNIT, self.constant(args[1], grid) if name == "predict_linear" else None)
        elif name == "quantile_over_time":
            found = W.quantile_over_time(df, keys, at, span, self.constant(args[0], grid))
        else:
            found = W.over_time(df, keys, at, span, SIMPLE[name])
        return self.finish(found, points, grid, pinned, name == "last_over_time")

    def absent(self, e: object, grid: Grid, over_time: bool) -> DataFrame:
        labels: dict[str, str] = {}
        if isinstance(e, ast.Selector):
            equal = [(n, v) for n, op, v in e.matchers if op == "=" and n != L.NAME]
            names = [n for n, _, _ in e.matchers]
            labels = {n: v for n, v in equal if names.count(n) == 1}
        present = self.range_call("present_over_time", [e], grid) if over_time else self.eval(e, grid)
        ts = grid.frame(self.spark).select(grid.time(F.col("k")).alias("ts"))
        return ts.join(present.select("ts").distinct(), "ts", "left_anti").select(L.const(labels).alias("labels"), "ts", lit(1.0).alias("v"))

    def aggregate(self, e: ast.Aggregate, grid: Grid) -> DataFrame:
        param = e.param.value if isinstance(e.param, ast.Text) else None if e.param is None else self.constant(e.param, grid)
        return VO.aggregate(self.eval(e.expr, grid), e.op, e.names, e.without, param)

    def binary(self, e: ast.Binary, grid: Grid) -> DataFrame | Scalar:
        left, right = self.eval(e.left, grid), self.eval(e.right, grid)
        m = e.matching
        if e.op in ast.SETS:
            return VO.set_op(left, right, e.op, m.on, m.names)
        compare = e.op in ast.COMPARISONS
        f = ieee.COMPARE[e.op] if compare else ieee.ARITHMETIC[e.op]
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            g = (lambda a, b: f(a, b).cast("double")) if compare else f
            if left.df is None and right.df is None:
                return Scalar(lambda ts: g(left.of(ts), right.of(ts)), None, folded(e.op, left.constant, right.constant))
            base, other = (left, right) if left.df is not None else (right, left)
            df, o = self.with_scalar(base.df, other, "other")
            a, b = (F.col("v"), o) if base is left else (o, F.col("v"))
            return Scalar(None, df.select("ts", g(a, b).alias("v")))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            vector, s = (right, left) if isinstance(left, Scalar) else (left, right)
            df, o = self.with_scalar(vector, s, "other")
            a, b = (o, F.col("v")) if s is left else (F.col("v"), o)
            if compare and not e.bool:
                return df.where(f(a, b)).select("labels", "ts", "v")
            return self.nameless(df.withColumn("v", f(a, b).cast("double")))
        return VO.binary(left, right, e.op, e.bool, m.on, m.names, m.group, m.include)


def folded(op: str, a: float | None, b: float | None) -> float | None:
    """The constant that two constants make, where that is plain."""
    if a is None or b is None:
        return None
    try:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[op]()
    except (KeyError, ZeroDivisionError, OverflowError):
        return None


def simplified(e: object) -> object:
    """The tree with unions of like selectors made one selector.

    a{l="x"} or a{l="y"}, alike but for the value of one equality and matched on
    all labels, is a{l=~"x|y"}.
    """
    for name in ("expr", "left", "right"):
        if (part := getattr(e, name, None)) is not None:
            setattr(e, name, simplified(part))
    if isinstance(e, ast.Call):
        e.args = [simplified(a) for a in e.args]
    if isinstance(e, ast.Binary) and e.op == "or" and e.matching.names is None and isinstance(e.left, ast.Selector) and isinstance(e.right, ast.Selector):
        joined = union(e.left, e.right)
        return e if joined is None else joined
    return e


def union(a: ast.Selector, b: ast.Selector) -> ast.Selector | None:
    plain = L._FINITE.match
    if (a.range_ns, a.offset_ns, a.at) != (b.range_ns, b.offset_ns, b.at) or len(a.matchers) != len(b.matchers):
        return None
    differing = [(x, y) for x, y in zip(a.matchers, b.matchers) if x != y]
    if not differing:
        return a
    if len(differing) != 1:
        return None
    (n1, op1, v1), (n2, op2, v2) = differing[0]
    if n1 != n2 or n1 == L.NAME or op1 not in ("=", "=~") or op2 != "=" or not v1 or not v2 or not plain(v1) or not plain(v2) or "|" in v2 or (op1 == "=" and "|" in v1):
        return None
    values = dict.fromkeys([*v1.split("|"), v2])
    return ast.Selector([(n1, "=~", "|".join(values)) if m == differing[0][0] else m for m in a.matchers], a.range_ns, a.offset_ns, a.at)
