"""mercata: seller analytics as lazy PySpark DataFrame plans.

Layers
------
sources    raw parquet tables and the canonical views built on them, CSV/parquet sinks
functions  column-level helpers (month keys, CASE ladders, rounding modes, safe ratios)
operators  reusable DataFrame operators (scans, joins, aggregates, windows, reshapes, sets)
plans      the composed jobs (segmentation, status change, accounts, ledger, top owners, follow-ups)
"""

from mercata.params import Params
from mercata.session import get_session

__all__ = ["Params", "get_session"]
