"""Reusable DataFrame operators (all lazy, all built-in Spark expressions)."""

from mercata.operators import aggregates, joins, reshape, scans, sets, windows

__all__ = ["aggregates", "joins", "reshape", "scans", "sets", "windows"]
