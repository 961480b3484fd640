"""Date helpers (FORMAT_DATE('%Y%m'), EXTRACT(year), DATE(ts))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c) -> Column:
    """DATE(timestamp); Catalyst unwraps range filters on it back to the parquet column."""
    return F.to_date(_c(c))


def month_key(c) -> Column:
    """'yyyyMM' text key of a date or timestamp."""
    return F.date_format(_c(c), "yyyyMM")


def month_number(c) -> Column:
    """yyyymm as an INT (the monthly dimension stores it that way)."""
    return (F.year(_c(c)) * 100 + F.month(_c(c))).cast("int")


def year_of(c) -> Column:
    return F.year(_c(c))
