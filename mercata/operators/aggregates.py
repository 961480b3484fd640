"""Aggregation operators: chained grains, grouping-set totals, shares, period counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.params import TOTAL_LABEL


def group_dropna(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` semantics: rows with a NULL key do not form a group."""
    return df.dropna(subset=list(keys))


def with_total(df: DataFrame, cat: str, label: str = TOTAL_LABEL) -> DataFrame:
    """Attach a second copy of every row whose ``cat`` is known, labelled ``label``.

    Feeding the result to one ``groupBy(*keys, cat)`` aggregates the per-category grain and the
    all-categories grain in the same pass (the reference ran the whole script twice).  Rows with an
    unknown category keep their NULL group and get no Total copy.  Spark plans it as one
    Expand-like Generate before the partial aggregate, so the shuffle is shared.
    """
    return df.withColumn(cat, F.explode(
        F.when(F.col(cat).isNull(), F.array(F.lit(None).cast("string")))
         .otherwise(F.array(F.col(cat), F.lit(label)))))


def count_periods_at_least(value: Column, limit) -> Column:
    """Number of rows (periods) of the group whose value reaches ``limit``."""
    return F.count_if(value >= F.lit(limit))


def counted(df: DataFrame, keys: Sequence[str], col: str, name: str = "_n") -> DataFrame:
    """Rows per (keys, value): the partial aggregate a bounded ordered list is built from."""
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias(name))


def ordered_list(col: str, count: str = "_n", sep: str = ", ") -> Column:
    """``string_agg`` with a fixed order, over ``counted`` rows: the values sorted, each repeated as
    often as it occurred, joined by ``sep``.

    Only (value, count) pairs are shuffled and collected per group; the string itself is as long as the
    group, which is what ``string_agg`` returns.  NULL values are skipped like ``string_agg`` does.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(col).alias("v"), F.col(count).cast("int").alias("n"))))
    return F.array_join(F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["v"], p["n"]))), sep)
