"""Result sinks (the analyst wrote Excel workbooks; here: partitioned Parquet or CSV).

Writes are whole-job outputs to a shared path.  With ``partition_by`` each month lands in its own folder and a
rerun replaces only the months it has: Spark stages the new folders beside the old ones and moves them in
when the whole job has succeeded, so a failed run leaves every month as it was (``_SUCCESS`` marks a finished one).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter


def _writer(df: DataFrame, partition_by: Sequence[str], mode: str) -> DataFrameWriter:
    w = df.write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)  # this writer only
    return w


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    _writer(df, partition_by, mode).parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    _writer(df, partition_by, mode).option("header", True).csv(path)
