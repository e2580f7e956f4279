"""Durations and byte sizes, as literals of a query and as texts of log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000, "y": 31_536_000_000_000_000}
BYTES = {"b": 1, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "pb": 1e15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}
DURATION = re.compile(r"(?:\d+(?:\.\d+)?(?:ns|us|µs|μs|ms|[smhdwy]))+")
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|[smhdwy])")
_SIZE = re.compile(r"(\d+(?:\.\d+)?)\s*([kmgtp]i?b|b)\Z", re.I)
GO_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def duration_ns(text: str) -> int:
    """The nanoseconds of a duration such as 1h30m."""
    if not DURATION.fullmatch(text):
        raise ValueError(f"no duration: {text}")
    return round(sum(float(n) * NS[u] for n, u in _PART.findall(text)))


def size_bytes(text: str) -> float | None:
    m = _SIZE.match(text)
    return float(m[1]) * BYTES[m[2].lower()] if m else None


def number(text: str) -> Column:
    """The double that a column's text spells, null if it spells none; text is the column's name."""
    return F.expr(f"""CASE WHEN {text} RLIKE r'{GO_FLOAT}' THEN try_cast({text} AS DOUBLE)
        WHEN lower({text}) IN ('inf', '+inf', 'infinity', '+infinity') THEN double('Infinity') WHEN lower({text}) IN ('-inf', '-infinity') THEN double('-Infinity')
        WHEN lower({text}) IN ('nan', '+nan', '-nan') THEN double('NaN') END""")


_UNIT = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h|d|w)"
_SCALES = ", ".join(f"'{u}', {n / 1e9!r}D" for u, n in NS.items() if u != "y")


def seconds(text: str) -> Column:
    """The seconds of a duration text such as 250ms or 1h30m, null if it is none; text is the column's name."""
    part = lambda i: f"regexp_extract_all({text}, r'{_UNIT}', {i})"
    total = f"aggregate(zip_with({part(1)}, {part(2)}, (n, u) -> double(n) * map({_SCALES})[u]), 0D, (a, x) -> a + x)"
    return F.expr(f"CASE WHEN {text} RLIKE r'^[+-]?0$' THEN 0D WHEN {text} RLIKE r'^[+-]?(?:{_UNIT})+$' THEN IF(startswith({text}, '-'), -1D, 1D) * {total} END")


_SIZES = ", ".join(f"'{u}', {float(n)!r}D" for u, n in {**BYTES, "": 1, "k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}.items())


def size(text: str) -> Column:
    """The bytes of a size text such as 1.5KiB or 512B; a bare number is bytes; null if it is neither; text is the column's name."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]*)$"
    return F.expr(f"CASE WHEN {text} RLIKE r'{pattern}' THEN try_cast(regexp_extract({text}, r'{pattern}', 1) AS DOUBLE) * try_element_at(map({_SIZES}), lower(regexp_extract({text}, r'{pattern}', 2))) END")
