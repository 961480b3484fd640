"""Set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(frames: dict[str, DataFrame], tag: str = "typ") -> DataFrame:
    """UNION ALL of frames with the same columns, each tagged with a literal (its dict key)."""
    out = None
    for label, df in frames.items():
        df = df.select(F.lit(label).alias(tag), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate by column name; a column missing on one side is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)
