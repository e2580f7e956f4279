"""LogQL trees as lazy DataFrame plans over a log store."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import ieee, parsers, units
from brightloom.functions import labels as L
from brightloom.functions.bind import bound
from brightloom.functions.ieee import lit
from brightloom.lang import logql as ast
from brightloom.lang.promql import Binary, Num
from brightloom.lang.tokens import QueryError
from brightloom.operators import vectors as VO
from brightloom.operators import windows as W
from brightloom.plans.grid import Grid

UNIT = 1_000_000_000
_SIMPLE = {"sum_over_time": "sum", "avg_over_time": "avg", "min_over_time": "min", "max_over_time": "max", "first_over_time": "first", "last_over_time": "last", "stddev_over_time": "stddev", "stdvar_over_time": "stdvar"}
_ANSI = "\x1b\\[[0-9;?]*[ -/]*[@-~]"


def lookup(name: str) -> Column:
    """A label's value from the running labels, else from the fields, under any accepted name."""
    return F.coalesce(F.nullif(L.aliased(F.col("labels"), name), F.lit("")), F.nullif(L.aliased(F.col("fields"), name), F.lit("")), F.lit(""))


def running(name: str) -> Column:
    """What a template's .name stands for: the running label of that very name, else the field."""
    return F.coalesce(F.col("labels")[name], F.col("fields")[name], F.lit(""))


def line_predicate(f: ast.LineFilter) -> Column:
    line = F.col("line")
    if f.op in ("|=", "!="):
        hit = F.contains(line, F.lit(f.text))
    elif f.op in ("|~", "!~"):
        hit = line.rlike(L.java_regex(f.text))
    else:
        hit = line.rlike(parsers.pattern_match_regex(f.text))
    return hit if f.op[0] == "|" else ~hit


_READ = {"number": units.number, "duration": units.seconds, "bytes": units.size}
_ORDER: dict[str, Callable[[Column, Column], Column]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def term_predicate(op: str, kind: str, literal: object, text: Column, read: Column | None) -> Column:
    """One comparison of a label filter; read: what the text spells, where it is compared as a number."""
    if kind == "text":
        if op in ("=", "==", "!="):
            return text != literal if op == "!=" else text == literal
        hit = L.matches(text, op, literal)
        return F.lit(True) if hit is None else hit
    number, spelt = literal
    if op in ("=", "=="):
        return text == spelt
    if op == "!=":
        return text != spelt
    if op not in _ORDER:
        raise QueryError("a pattern is a string")
    return F.coalesce(_ORDER[op](read, F.lit(float(number))) & ~F.isnan(read), F.lit(False))


def filtered(rows: DataFrame, f: ast.LabelFilter, look: Callable[[str], Column] = lookup) -> DataFrame:
    """The rows that pass a label filter; what is read as a number is read once."""
    read = {i: (look(name), kind) for i, (name, op, kind, _) in enumerate(f.terms) if kind != "text" and op in _ORDER}
    held = bound(bound(rows, {f"text{i}": c for i, (c, _) in read.items()}), {f"read{i}": _READ[kind](f"text{i}") for i, (_, kind) in read.items()})
    out = None
    for i, (name, op, kind, literal) in enumerate(f.terms):
        p = term_predicate(op, kind, literal, F.col(f"text{i}") if i in read else look(name), F.col(f"read{i}") if i in read else None)
        out = p if out is None else out | p if f.connectors[i - 1] == "or" else out & p
    return held.where(out).select(*rows.columns)


def unwrapped(rows: DataFrame, text: Column, how: str) -> DataFrame:
    """rows with the number that a text spells in column unwrap."""
    rows = bound(rows.drop("unwrap"), {"text": text})
    return bound(bound(rows, {"unwrap": _READ[how]("text")}).drop("text"), {"unwrap": F.when(~F.isnan("unwrap"), F.col("unwrap"))})


def failed(error: str) -> Column:
    """The labels with __error__, unless one is set already."""
    labels = F.col("labels")
    return F.when(F.map_contains_key(labels, F.lit("__error__")), labels).otherwise(L.put(labels, "__error__", F.lit(error)))


def stage(rows: DataFrame, s: object) -> DataFrame:
    """One pipeline stage over rows (t, observed, line, labels, fields, unwrap)."""
    labels, line = F.col("labels"), F.col("line")
    if isinstance(s, ast.LineFilter):
        return rows.where(line_predicate(s))
    if isinstance(s, ast.LabelFilter):
        return filtered(rows, s)
    if s.name == "json" and s.args:
        rows = bound(rows, {"bad": F.get_json_object(line, "$").isNull()} | {f"found{i}": parsers.json_field(line, path) for i, (_, path) in enumerate(s.args)})
        for i, (name, _) in enumerate(s.args):
            found = F.col(f"found{i}")
            rows = bound(rows, {"labels": F.when(found.isNull(), labels).otherwise(L.put(labels, name, found))})
        return bound(rows, {"labels": F.when(F.col("bad"), failed("JSONParserErr")).otherwise(labels)}).drop("bad", *[f"found{i}" for i in range(len(s.args))])
    if s.name == "json":
        rows = parsers.with_json_labels(rows, "parsed")
        return bound(rows, {"labels": F.when(F.col("parsed").isNull(), failed("JSONParserErr")).otherwise(L.merge(labels, F.col("parsed")))}).drop("parsed")
    if s.name == "logfmt":
        return bound(bound(rows, {"parsed": parsers.logfmt_labels(line)}), {"labels": L.merge(labels, F.col("parsed"))}).drop("parsed")
    if s.name in ("regexp", "pattern"):
        regex = s.args[0] if s.name == "regexp" else parsers.pattern_regex(s.args[0])
        if "(?<" not in regex and "(?P<" not in regex:
            return rows
        rows = bound(rows, {"parsed": parsers.capture_labels(line, regex)})
        return bound(rows, {"labels": F.when(F.col("parsed").isNull(), labels).otherwise(L.merge(labels, F.col("parsed")))}).drop("parsed")
    if s.name == "line_format":
        return bound(rows, {"line": parsers.template(s.args[0], running, line)})
    if s.name == "label_format":
        for name, how, text in s.args:
            rows = bound(rows, {"new": parsers.template(text, running, line) if how == "template" else lookup(text)})
            rows = bound(rows, {"labels": L.put(labels, name, F.col("new"))}).drop("new")
        return rows
    if s.name in ("drop", "keep"):
        f = L.without if s.name == "drop" else (lambda m, names: L.only(m, [*names, "__error__"]))
        return rows.withColumn("labels", f(labels, s.args)).withColumn("fields", f(F.col("fields"), s.args))
    if s.name == "decolorize":
        return bound(rows, {"line": F.regexp_replace(line, _ANSI, "")})
    if s.name == "unwrap":
        rows = unwrapped(rows, lookup(s.args[0]), s.args[1])
        return bound(rows, {"labels": F.when(F.col("unwrap").isNull(), failed("SampleExtractionErr")).otherwise(labels)})
    raise QueryError(f"unknown stage {s.name}")


def synonyms(name: str) -> tuple[str, ...]:
    return L.LEVELS if name in L.LEVELS else L.SERVICES if name in L.SERVICES else (name,)


def needed(stages: list, names: Sequence[str]) -> list[str]:
    """The labels that the stages and a grouping by names look at."""
    out = list(names)
    for s in stages:
        if isinstance(s, ast.LabelFilter):
            out += [t[0] for t in s.terms]
        elif isinstance(s, ast.Stage):
            if s.name == "unwrap":
                out.append(s.args[0])
            elif s.name == "line_format":
                out += re.findall(r"\.([a-zA-Z_]\w*)", s.args[0])
            elif s.name == "label_format":
                out += [n for to, how, text in s.args for n in (to, *([text] if how == "copy" else re.findall(r"\.([a-zA-Z_]\w*)", text)))]
    return list(dict.fromkeys(a for n in out for a in synonyms(n)))


def pushed_grouping(e: ast.VectorAggregate) -> ast.RangeAggregate | None:
    """sum by (l) of a count or sum of all rows is the count or sum by l: no grouping by whole label sets is needed."""
    r = e.expr
    if e.op != "sum" or e.without or not isinstance(r, ast.RangeAggregate) or r.names is not None or r.op not in ("count_over_time", "rate", "bytes_over_time", "bytes_rate", "sum_over_time"):
        return None
    return ast.RangeAggregate(r.op, r.logs, r.range_ns, r.offset_ns, r.param, list(e.names or []), False)


class Lean:
    """A pipeline over rows that keeps each needed label in a column of its own.

    No label map is built; a parser reads only what is asked for.
    """

    def __init__(self, rows: DataFrame, stages: list, names: Sequence[str]) -> None:
        self.names = needed(stages, names)
        self.rows = rows.select("t", "line", F.lit(None).cast("double").alias("unwrap"), *[F.col("labels")[n].alias(self.at(n)) for n in self.names], *[F.col("fields")[n].alias(self.at(n) + "f") for n in self.names])
        for s in stages:
            self.stage(s)

    def at(self, name: str) -> str:
        return f"l{self.names.index(name)}"

    def look(self, name: str) -> Column:
        order = [name, *[n for n in synonyms(name) if n != name]]
        return F.coalesce(*[F.nullif(F.col(self.at(n) + side), F.lit("")) for side in ("", "f") for n in order], F.lit(""))

    def label(self, name: str) -> Column:
        order = [name, *[n for n in synonyms(name) if n != name]]
        return F.coalesce(*[F.nullif(F.col(self.at(n)), F.lit("")) for n in order], F.lit(""))

    def exact(self, name: str) -> Column:
        return F.coalesce(self.at(name), self.at(name) + "f", F.lit(""))

    def put(self, found: dict[str, Column]) -> None:
        self.rows = bound(self.rows, {self.at(n): F.coalesce(c, F.col(self.at(n))) for n, c in found.items() if n in self.names})

    def fail(self, when: Column, error: str) -> None:
        if "__error__" in self.names:
            at = self.at("__error__")
            self.rows = bound(self.rows, {at: F.when(when & F.col(at).isNull(), error).otherwise(F.col(at))})

    def stage(self, s: object) -> None:
        line = F.col("line")
        if isinstance(s, ast.LineFilter):
            self.rows = self.rows.where(line_predicate(s))
        elif isinstance(s, ast.LabelFilter):
            self.rows = filtered(self.rows, s, self.look)
        elif s.name == "json" and s.args:
            if "__error__" in self.names:
                self.fail(F.get_json_object(line, "$").isNull(), "JSONParserErr")
            self.put({n: parsers.json_field(line, path) for n, path in s.args})
        elif s.name == "json":
            wanted = [n for n in self.names if not n.startswith("__")]
            if "__error__" not in self.names and not any("_" in n for n in wanted):
                self.put({n: F.get_json_object(line, f"$['{n}']") for n in wanted})  # a name without an underscore is a key of the object itself
            else:
                self.rows = parsers.with_json_labels(self.rows, "parsed")
                self.fail(F.col("parsed").isNull(), "JSONParserErr")
                self.put({n: F.col("parsed")[n] for n in wanted})
                self.rows = self.rows.drop("parsed")
        elif s.name == "logfmt":
            self.put({n: parsers.logfmt_value(line, n) for n in self.names})
        elif s.name in ("regexp", "pattern"):
            regex, number = parsers.capture_numbers(s.args[0] if s.name == "regexp" else parsers.pattern_regex(s.args[0]))
            self.put({n: F.when(line.rlike(regex), F.regexp_extract(line, regex, i)) for n, i in number.items()})
        elif s.name == "line_format":
            self.rows = bound(self.rows, {"line": parsers.template(s.args[0], self.exact, line)})
        elif s.name == "label_format":
            for name, how, text in s.args:
                self.rows = bound(self.rows, {self.at(name): parsers.template(text, self.exact, line) if how == "template" else self.look(text)})
        elif s.name in ("drop", "keep"):
            gone = [n for n in self.names if (n in s.args) == (s.name == "drop") and n != "__error__"]
            self.rows = self.rows.withColumns({self.at(n) + side: F.lit(None).cast("string") for n in gone for side in ("", "f")})
        elif s.name == "decolorize":
            self.rows = bound(self.rows, {"line": F.regexp_replace(line, _ANSI, "")})
        elif s.name == "unwrap":
            self.rows = unwrapped(self.rows, self.look(s.args[0]), s.args[1])
            self.fail(F.col("unwrap").isNull(), "SampleExtractionErr")


def pipeline(rows: DataFrame, stages: list) -> DataFrame:
    for s in stages:
        rows = stage(rows, s)
    return rows


class Compiler:
    """Compiles one query over times start, start + step, ... in nanoseconds.

    Metric results are frames (labels, ts in milliseconds, v).
    """

    def __init__(self, store: object, start_ns: int, end_ns: int, step_ns: int, instant: bool = False) -> None:
        if not instant:  # whole steps
            start_ns, end_ns = -(-start_ns // step_ns) * step_ns, -(-end_ns // step_ns) * step_ns
        self.store, self.grid, self.spark = store, Grid(start_ns, end_ns, step_ns), store.spark

    def rows(self, q: ast.LogQuery, start_ns: int, end_ns: int) -> DataFrame:
        """Rows after the pipeline, with start_ns < t <= end_ns."""
        return pipeline(self.raw(q, start_ns, end_ns), q.stages)

    def raw(self, q: ast.LogQuery, start_ns: int, end_ns: int) -> DataFrame:
        df = self.store.select(q.matchers, start_ns, end_ns)
        return df.select(F.col("ts_ns").alias("t"), F.col("observed_ns").alias("observed"), "line", F.col("stream").alias("labels"), "fields", F.lit(None).cast("double").alias("unwrap"))

    def logs(self, q: ast.LogQuery, limit: int | None = 100, forward: bool = False) -> DataFrame:
        """Rows (labels, ts_ns, line) in time order, at most `limit`."""
        g = self.grid
        df = self.rows(q, g.start - 1, g.end).select(L.shown(F.col("labels")).alias("labels"), F.col("t").alias("ts_ns"), "line", "observed")
        order = [F.col("ts_ns").asc(), F.col("observed").asc()] if forward else [F.col("ts_ns").desc(), F.col("observed").desc()]
        df = df.orderBy(*order, "line")
        return (df if limit is None else df.limit(limit)).select("labels", "ts_ns", "line")

    def streams(self, q: ast.LogQuery, limit: int | None = 100, forward: bool = False) -> DataFrame:
        """(labels, values [(ts_ns, line)]) for each label set of logs()."""
        found = self.logs(q, limit, forward)
        values = F.sort_array(F.collect_list(F.struct("ts_ns", "line")), asc=forward)
        return found.groupBy("labels").agg(values.alias("values"))

    def compile(self, e: object) -> DataFrame:
        if isinstance(e, ast.LogQuery):
            return self.logs(e)
        out = self.eval(e)
        return self.constant(out) if isinstance(out, float) else out.select("labels", "ts", "v")

    def times(self) -> DataFrame:
        g = self.grid
        return g.frame(self.spark).select(self.ms(F.col("k")).alias("ts"))

    def ms(self, k: Column) -> Column:
        return F.floor(self.grid.time(k) / 1_000_000).cast("bigint")

    def constant(self, x: float) -> DataFrame:
        return self.times().select(L.empty().alias("labels"), "ts", lit(x).alias("v"))

    def eval(self, e: object) -> DataFrame | float:
        match e:
            case Num():
                return e.value
            case ast.Vector():
                return self.constant(e.value)
            case ast.RangeAggregate():
                return self.range_aggregate(e)
            case ast.VectorAggregate():
                if (pushed := pushed_grouping(e)) is not None:
                    return self.range_aggregate(pushed)
                return VO.aggregate(self.frame(e.expr), e.op, e.names, e.without, e.param)
            case ast.LabelCall():
                inner = self.frame(e.expr)
                if e.name == "label_join":
                    return VO.label_join(inner, e.args[0], e.args[1], e.args[2:])
                return VO.label_replace(inner, e.args[0], e.args[1], e.args[2], e.args[3], anchored=False)
            case Binary():
                return self.binary(e)
        raise QueryError("a log selector is no metric")

    def frame(self, e: object) -> DataFrame:
        out = self.eval(e)
        return self.constant(out) if isinstance(out, float) else out

    def range_aggregate(self, e: ast.RangeAggregate) -> DataFrame:
        at, span = self.grid.shifted(-e.offset_ns), e.range_ns
        first, last = at.start - span, at.start + at.last * at.step
        if e.op == "absent_over_time":
            rows = Lean(self.raw(e.logs, first, last), e.logs.stages, []).rows
            present = W.over_time(rows.select("t", lit(1.0).alias("v")), [], at, span, "present")
            missing = self.grid.frame(self.spark).join(present, "k", "left_anti")
            return missing.select(L.empty().alias("labels"), self.ms(F.col("k")).alias("ts"), lit(1.0).alias("v"))
        if self.from_minutes(e):
            return self.minutes(e, at, span, first, last)
        grouped = e.names is not None and not e.without
        names = sorted(set(e.names)) if grouped else []
        lean = Lean(self.raw(e.logs, first, last), e.logs.stages, names) if grouped else None
        rows = lean.rows if grouped else self.rows(e.logs, first, last)
        if e.op in ("count_over_time", "rate"):
            function, value = "count", lit(1.0)
        elif e.op in ("bytes_over_time", "bytes_rate"):
            function, value = "sum", F.octet_length("line").cast("double")
        else:
            function, value = _SIMPLE.get(e.op, ""), F.col("unwrap")
            rows = rows.where("unwrap is not null")
        if grouped:
            keys = [f"g{i}" for i in range(len(names))]
            points = rows.select("t", value.alias("v"), *[F.nullif(lean.label(n), F.lit("")).alias(k) for n, k in zip(names, keys)])
            labels = L.build([(n, F.col(k)) for n, k in zip(names, keys)])
        else:
            shown = L.shown(F.col("labels"))
            kept = L.without(shown, e.names) if e.without else shown
            keys, points = ["key"], rows.select("t", value.alias("v"), L.key(kept).alias("key"))
            labels = L.from_key(F.col("key"))
        if e.op == "quantile_over_time":
            found = W.quantile_over_time(points, keys, at, span, e.param, nearest=True)
        else:
            found = W.over_time(points, keys, at, span, function)
        v = F.col("v") / (span / UNIT) if e.op in ("rate", "bytes_rate") else F.col("v")
        return found.select(labels.alias("labels"), self.ms(F.col("k")).alias("ts"), v.alias("v")).where("v is not null")

    def from_minutes(self, e: ast.RangeAggregate) -> bool:
        """Whether the store's counts for each minute answer a query: whole minutes, and nothing but streams is looked at."""
        whole = all(x % 60_000_000_000 == 0 for x in (self.grid.start, self.grid.step, e.range_ns, e.offset_ns))
        return self.store.stats is not None and whole and not e.logs.stages and e.names is not None and not e.without and e.op in ("count_over_time", "rate", "bytes_over_time", "bytes_rate")

    def minutes(self, e: ast.RangeAggregate, at: Grid, span: int, first: int, last: int) -> DataFrame:
        names = sorted(set(e.names))
        value = F.col("byte_count" if e.op.startswith("bytes") else "log_count").cast("double")
        keys = [F.nullif(L.aliased(F.col("stream"), n), F.lit("")).alias(f"g{i}") for i, n in enumerate(names)]
        points = self.store.select_minutes(e.logs.matchers, first, last).select("t", value.alias("v"), *keys)
        found = W.over_time(points, [f"g{i}" for i in range(len(names))], at, span, "sum")
        v = F.col("v") / (span / UNIT) if e.op in ("rate", "bytes_rate") else F.col("v")
        return found.select(L.build([(n, F.col(f"g{i}")) for i, n in enumerate(names)]).alias("labels"), self.ms(F.col("k")).alias("ts"), v.alias("v"))

    def binary(self, e: Binary) -> DataFrame | float:
        left, right = self.eval(e.left), self.eval(e.right)
        m = e.matching
        if e.op in ("and", "or", "unless"):
            left, right = (self.constant(x) if isinstance(x, float) else x for x in (left, right))
            return VO.set_op(left, right, e.op, m.on, m.names)
        compare = e.op in ieee.COMPARE
        if isinstance(left, float) and isinstance(right, float):
            left = self.constant(left)
        if isinstance(left, float) or isinstance(right, float):
            vector = right if isinstance(left, float) else left
            a, b = (lit(left), F.col("v")) if isinstance(left, float) else (F.col("v"), lit(right))
            if not compare:
                return vector.withColumn("v", ieee.ARITHMETIC[e.op](a, b))
            hit = ieee.COMPARE[e.op](a, b)
            if e.bool:
                return vector.withColumn("v", hit.cast("double"))
            return vector.where(hit).withColumn("v", a)  # the left operand's value
        return VO.binary(left, right, e.op, e.bool, m.on, m.names, m.group, m.include, first_match=True)
