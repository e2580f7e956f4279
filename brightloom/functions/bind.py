"""Columns that are computed once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, new or in place of old ones.

    Catalyst copies what a projection computes into every use above it, filters
    included, so a chain of stages that look at a column several times each
    grows by powers. A generator is not copied; predicates on other columns still
    pass below it and reach the scan.
    """
    if not columns:
        return df
    return df.select(*[f"`{c}`" for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
