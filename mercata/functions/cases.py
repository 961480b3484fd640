"""CASE helpers: code decode, first-match ladders, 0/1 flags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(c: Column, mapping: Mapping, default=None) -> Column:
    """Simple CASE: ``CASE c WHEN k THEN v ... ELSE default END``."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def case_ladder(branches: Iterable[tuple[Column, object]], default) -> Column:
    """Searched CASE, first true condition wins; a NULL condition is not taken."""
    out = None
    for cond, value in branches:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d)


def flag(cond: Column, yes=1, no=0) -> Column:
    """Binary flag; a NULL condition gives ``no``."""
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def any_flag(c) -> Column:
    """Aggregate: 1 if any value of the group is > 0 else 0 (sum > 0 of non-negative counts)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.sum(col) > 0, 1).otherwise(0)
