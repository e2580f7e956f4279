"""Label sets as map columns, their canonical keys, and matchers on them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
LEVELS = ("level", "severity", "severity_text", "detected_level")
SERVICES = ("service_name", "service.name")
_FINITE = re.compile(r"[\w :/@-]+(?:\|[\w :/@-]+)*\Z")
_ANY = frozenset((".*", "(.*)", "(?:.*)", "^.*$", "^.*", ".*$", "^(?:.*)$", "^(.*)$", "(?s:.*)", "(?s).*"))


def empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def const(labels: dict[str, str]) -> Column:
    kept = {k: v for k, v in labels.items() if v != ""}
    return F.create_map(*[F.lit(x) for kv in sorted(kept.items()) for x in kv]) if kept else empty()


def build(pairs: Sequence[tuple[str, Column]]) -> Column:
    """A map of the pairs whose value is neither null nor empty; names are distinct."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")) if pairs else empty()


def value(labels: Column, name: str) -> Column:
    """The label's value, the empty string if it is missing."""
    return F.coalesce(labels[name], F.lit(""))


def key(labels: Column) -> Column:
    """One string for a label set, whatever the order of its labels."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"])), "\x02")


def from_key(text: Column) -> Column:
    """The label set of a key."""
    return F.when(text == "", empty()).otherwise(F.str_to_map(text, F.lit("\x02"), F.lit("\x01")))


def only(labels: Column, names: Iterable[str]) -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, _: k.isin(names)) if names else empty()


def without(labels: Column, names: Iterable[str]) -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, _: ~k.isin(names)) if names else labels


def shown(labels: Column) -> Column:
    """Without the labels whose names begin with two underscores, and without empty ones."""
    return F.map_filter(labels, lambda k, v: ~k.startswith("__") & (v != ""))


def merge(first: Column, second: Column) -> Column:
    """Both maps' labels; the second's values win."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def put(labels: Column, name: str, new: Column) -> Column:
    """The label set to a new value; dropped where that is null or empty."""
    rest = without(labels, [name])
    return F.when(F.coalesce(new, F.lit("")) == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), new)))


def java_regex(pattern: str) -> str:
    """A pattern in RE2's syntax as one of Java's."""
    for bad in ("(?=", "(?!", "(?<=", "(?<!", "(?>"):
        if bad in pattern:
            raise ValueError(f"unsupported in regular expressions: {bad}")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError("back references are unsupported in regular expressions")
    return pattern.replace("(?P<", "(?<").replace(r"\z", r"\z").replace("(?U)", "")


def anchored(pattern: str) -> str:
    return f"^(?:{java_regex(pattern)})$"


def matches(subject: Column, op: str, literal: str) -> Column | None:
    """The predicate of a matcher; None where it holds for everything."""
    if op == "=":
        return subject == literal
    if op == "!=":
        return subject != literal
    if literal in _ANY:
        return None if op == "=~" else F.lit(False)
    if literal == "":
        hit = subject == ""
    elif _FINITE.match(literal):
        hit = subject.isin(literal.split("|"))
    else:
        hit = subject.rlike(anchored(literal))
    return hit if op == "=~" else ~hit


def contradictory(matchers: Iterable[tuple[str, str, str]]) -> bool:
    """Whether equality and finite alternatives leave some label no value."""
    allowed: dict[str, set[str]] = {}
    for name, op, literal in matchers:
        if op == "=" or (op == "=~" and _FINITE.match(literal)):
            now = {literal} if op == "=" else set(literal.split("|"))
            allowed[name] = allowed[name] & now if name in allowed else now
    for name, op, literal in matchers:
        if op == "!=" and name in allowed:
            allowed[name].discard(literal)
    return any(not v for v in allowed.values())


def aliased(labels: Column, name: str) -> Column:
    """A log label under any of its accepted names."""
    names = LEVELS if name in LEVELS else SERVICES if name in SERVICES else (name,)
    ordered = [name, *[n for n in names if n != name]]
    return F.coalesce(*[F.nullif(labels[n], F.lit("")) for n in ordered], F.lit(""))
