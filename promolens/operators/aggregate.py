"""Grouped sums with the source application's key semantics.

The source groups with pandas, which drops every row that has a NULL in any
grouping key; Spark keeps NULL groups, so the keys are filtered first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null_keys(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
           drop_null_keys: bool = True) -> DataFrame:
    """``groupBy(keys).sum(measures)``; rows with a NULL key are dropped first.

    Spark plans this as partial aggregation before the shuffle and final
    aggregation after it, so a hot key is collapsed map-side.
    """
    src = df.where(not_null_keys(keys)) if drop_null_keys else df
    return src.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def sum_all(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Totals over the whole frame, no key (AGG_GLOBAL): one row."""
    return df.agg(*[F.sum(m).alias(m) for m in measures])
