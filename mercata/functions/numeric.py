"""Rounding modes and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, scale: int = 0) -> Column:
    """SQL ROUND: half away from zero."""
    return F.round(_c(c), scale)


def half_even(c, scale: int = 0) -> Column:
    """pandas ``Series.round``: half to even (banker's rounding)."""
    return F.bround(_c(c), scale)


def safe_ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (instead of a division error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def report_round(c, scale: int = 4) -> Column:
    """Round a DOUBLE for reporting, half-up to ``scale`` places.

    The cast to DECIMAL(38,10) only takes off the binary noise of the double (values that sit on a
    tie, x.xxxx5, are common); it keeps 10 places, so a value near a tie is not pushed over it.
    """
    return F.round(_c(c).cast("decimal(38,10)"), scale).cast("double")
