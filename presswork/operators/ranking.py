"""Keep-first, first-n and fallback over explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, by: list[str], *order: str | Column) -> DataFrame:
    """The first ``n`` rows of each group in a total order (a null key is a group)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row for each key, the first in the order; rows without a key are one group."""
    return first_n(df, 1, [key], *order)


def first_non_empty(df: DataFrame, by: list[str], *rank: str) -> DataFrame:
    """Of each group only the rows of its first rank: the fallback chain.

    ``rank`` columns compare one after the other. The least rank is found by
    partial aggregation, so no group is collected.
    """
    least = df.groupBy(*by).agg(F.min(F.struct(*rank)).alias("_least"))
    joined = df.join(least, by)
    return joined.where(F.struct(*rank) == F.col("_least")).drop("_least")


def ordered_distinct(values: Column) -> Column:
    """Distinct elements of an array in the order of their first occurrence."""
    return F.array_distinct(values)
