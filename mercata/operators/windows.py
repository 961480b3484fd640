"""Window operators.  Every window is partitioned (no global window): the partition keys are
entity ids whose row counts are bounded by the grain (years per seller, categories per owner,
labels per year)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_delta(df: DataFrame, part: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """``col - LAG(col)`` over the previous present row of the partition; NULL on the first row."""
    w = Window.partitionBy(*part).orderBy(order)
    return df.withColumn(name, F.col(col) - F.lag(col).over(w))


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[Column], name: str = "ranking") -> DataFrame:
    """SQL ``RANK()`` (ties share a rank, gaps after ties)."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(*order)))


def share_of_group(df: DataFrame, part: Sequence[str], col: str, name: str) -> DataFrame:
    """``x / sum(x)`` within the partition (pandas group-apply ``x / x.sum()``)."""
    w = Window.partitionBy(*part)
    return df.withColumn(name, F.col(col).cast("double") / F.sum(col).over(w).cast("double"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key under an explicit order (pandas ``drop_duplicates(keep='first')``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
