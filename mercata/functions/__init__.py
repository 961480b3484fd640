"""Column-level helpers; all built-in Spark expressions (JVM side, codegen-friendly)."""

from mercata.functions.cases import any_flag, case_ladder, decode, flag
from mercata.functions.dates import day_of, month_key, month_number, year_of
from mercata.functions.numeric import half_even, report_round, round_half_up, safe_ratio

__all__ = ["any_flag", "case_ladder", "decode", "flag", "day_of", "month_key", "month_number", "year_of",
           "half_even", "report_round", "round_half_up", "safe_ratio"]
