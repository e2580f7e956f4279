"""Arithmetic on doubles as IEEE 754 has it; Spark gives errors or nulls instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), lit(NAN)).when((a > 0) == (F.signum(1 / F.when(b != 0, b).otherwise(lit(1))) > 0), lit(INF)).otherwise(lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, F.when(b != 0, b)))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def log(a: Column, base: float | None = None) -> Column:
    scaled = F.log(a) if base is None else F.log2(a) if base == 2 else F.log10(a)
    return F.when(F.isnan(a) | (a < 0), lit(NAN)).when(a == 0, lit(-INF)).otherwise(scaled)


def sqrt(a: Column) -> Column:
    return F.when(a < 0, lit(NAN)).otherwise(F.sqrt(a))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": power, "atan2": lambda a, b: F.atan2(a, b)}
COMPARE = {
    "==": lambda a, b: (a == b) & ~F.isnan(a) & ~F.isnan(b),
    "!=": lambda a, b: (a != b) | F.isnan(a) | F.isnan(b),
    ">": lambda a, b: (a > b) & ~F.isnan(a) & ~F.isnan(b),
    "<": lambda a, b: (a < b) & ~F.isnan(a) & ~F.isnan(b),
    ">=": lambda a, b: (a >= b) & ~F.isnan(a) & ~F.isnan(b),
    "<=": lambda a, b: (a <= b) & ~F.isnan(a) & ~F.isnan(b),
}


def fixed(v: Column) -> Column:
    """A value as text: integers without a fraction, NaN, +Inf, -Inf."""
    whole = (v == F.floor(v).cast("double")) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == INF, "+Inf").when(v == -INF, "-Inf").when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))
