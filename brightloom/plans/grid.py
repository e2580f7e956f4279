"""Evaluation grids, and the fan-out of points to the windows that hold them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Times start, start + step, ... up to end, in any unit of whole numbers."""

    start: int
    end: int
    step: int

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def shifted(self, by: int) -> "Grid":
        return Grid(self.start + by, self.end + by, self.step)

    def time(self, k: Column) -> Column:
        return F.lit(self.start) + k.cast("long") * F.lit(self.step)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row (k) for each time."""
        return spark.range(self.last + 1).select(F.col("id").cast("int").alias("k"))


def floor_div(x: Column, by: int) -> Column:
    """The whole number below x / by."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def ceil_div(x: Column, by: int) -> Column:
    return floor_div(x + (by - 1), by)


def fan_out(points: DataFrame, grid: Grid, window: int, t: str = "t") -> DataFrame:
    """Each point once for each k whose window (T_k - window, T_k] holds it.

    The k of a point are a range, so this is an explode of a sequence, not a
    join of points with times.
    """
    at = F.col(t)
    low = F.greatest(F.lit(0).cast("bigint"), ceil_div(at - grid.start, grid.step)).cast("int")
    high = F.least(F.lit(grid.last).cast("bigint"), floor_div(at + (window - 1 - grid.start), grid.step)).cast("int")
    inside = points.where((at > grid.start - window) & (at <= grid.start + grid.last * grid.step))
    if window <= grid.step:  # at most one window holds a point
        return inside.withColumn("k", low).where(F.col("k") <= high)
    return inside.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def buckets(points: DataFrame, grid: Grid, window: int, t: str = "t") -> DataFrame | None:
    """Each point with the step b that ends at or after it, where windows are
    whole numbers of steps; else None. A bucket is in the windows of
    k = b .. b + window/step - 1."""
    if grid.last == 0 or window % grid.step or window // grid.step < 2:
        return None
    at = F.col(t)
    inside = points.where((at > grid.start - window) & (at <= grid.start + grid.last * grid.step))
    return inside.withColumn("b", ceil_div(at - grid.start, grid.step).cast("int"))


def fan_out_buckets(partials: DataFrame, grid: Grid, window: int) -> DataFrame:
    """Each bucket of partial results once for each window that holds it."""
    low = F.greatest(F.col("b"), F.lit(0))
    high = F.least(F.col("b") + (window // grid.step - 1), F.lit(grid.last))
    return partials.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "b")
