"""Scan-side operators: date ranges, snapshot days, history current rows, key-only scans.

All are plain ``where`` / ``select``; when the date column is ``DATE(ts)`` of a parquet column,
Catalyst unwraps the cast and the bounds reach the scan as PushedFilters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.params import CURRENT_ROW


def date_range(df: DataFrame, col: str, start, stop) -> DataFrame:
    """``col BETWEEN start AND stop`` (both ends included)."""
    return df.where(F.col(col).between(F.lit(start), F.lit(stop)))


def snapshot(df: DataFrame, col: str, day) -> DataFrame:
    """One day of a daily snapshot table (``as_of`` is a parameter, never current_date())."""
    return df.where(F.col(col) == F.lit(day))


def open_range(df: DataFrame, col: str, start) -> DataFrame:
    return df.where(F.col(col) >= F.lit(start))


def trailing_days(df: DataFrame, col: str, as_of: dt.date, days: int) -> DataFrame:
    """The ``days`` days ending on ``as_of`` (both ends included)."""
    return date_range(df, col, as_of - dt.timedelta(days=days - 1), as_of)


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def current_rows(df: DataFrame, marker: str, current: str = CURRENT_ROW) -> DataFrame:
    """Current version of each row of a history table."""
    return df.where(F.col(marker) == current)
