"""Reshape operators: named pivots, quantile matrix, unpivot, month spine, dense panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named_pivot(df: DataFrame, group: Sequence[str], pivot_col: str, values: Sequence[str],
                agg: Column, prefix: str, suffix: str = "") -> DataFrame:
    """PIVOT over an explicit value list, columns named ``{prefix}{value}{suffix}``.

    An explicit list avoids the extra job Spark runs to discover the values; rows whose only
    pivot values are outside the list stay, with NULLs.
    """
    out = df.groupBy(*group).pivot(pivot_col, list(values)).agg(agg)
    for v in values:
        out = out.withColumnRenamed(str(v), f"{prefix}{v}{suffix}")
    return out


def unpivot_matrix(df: DataFrame, id_col: str, value_cols: Sequence[str], var_name: str,
                   value_name: str) -> DataFrame:
    return df.unpivot([id_col], list(value_cols), var_name, value_name)


def month_spine(spark: SparkSession, start: dt.date, stop: dt.date, name: str = "month") -> DataFrame:
    """One row per month from ``start`` to ``stop`` as yyyyMM text (GENERATE_DATE_ARRAY + UNNEST)."""
    dates = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(stop), F.expr("INTERVAL 1 MONTH"))).alias("date"))
    return dates.select(F.date_format("date", "yyyyMM").alias(name))


def with_months(entities: DataFrame, start: dt.date, stop: dt.date, name: str = "month") -> DataFrame:
    """Entity x month grid, generated per entity row (a Generate, not a cartesian join)."""
    seq = F.sequence(F.lit(start), F.lit(stop), F.expr("INTERVAL 1 MONTH"))
    return (entities.withColumn("__d", F.explode(seq))
            .withColumn(name, F.date_format("__d", "yyyyMM")).drop("__d"))


def fill_months(entities: DataFrame, measures: Mapping[str, DataFrame], keys: Sequence[str], start: dt.date, stop: dt.date,
                name: str = "month") -> DataFrame:
    """Entity x month with one column a measure, NULL in the gaps.

    ``measures`` are frames (keys, month as yyyyMM, value named like the measure, at most one row a month).  All of
    them are folded into maps from month to value by one aggregation over the keys, joined to the entities once;
    a map has at most one entry a month of the range."""
    kinds = {m: df.schema[m].dataType for m, df in measures.items()}
    rows = None
    for m, df in measures.items():
        own = df.select(*keys, name, *[F.col(x) if x == m else F.lit(None).cast(kinds[x]).alias(x) for x in measures])
        rows = own if rows is None else rows.unionByName(own)
    maps = rows.groupBy(*keys).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col(m).isNotNull(), F.struct(name, m)))).alias(f"__{m}") for m in measures])
    months = F.transform(F.sequence(F.lit(start), F.lit(stop), F.expr("INTERVAL 1 MONTH")), lambda d: F.date_format(d, "yyyyMM"))
    grid = entities.select(*keys).join(maps, list(keys), "left").withColumn(name, F.explode(months))
    return grid.select(*keys, name, *[F.try_element_at(f"__{m}", F.col(name)).alias(m) for m in measures])
