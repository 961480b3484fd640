"""Join operators.

Physical strategy is left to Catalyst/AQE: a side is broadcast only when Spark's size check
(``spark.sql.autoBroadcastJoinThreshold``, re-checked by AQE at runtime) picks it.  Skewed keys on
the streamed side of inner / left joins are split by AQE's skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def existence_flag(left: DataFrame, right: DataFrame, left_on, right_on=None, name: str = "flag",
                   yes=1, no=0) -> DataFrame:
    """Mark join: ``name`` = yes if the key exists in ``right`` else no.

    The right side is reduced to its distinct keys first, so the left rows are never multiplied
    (the reference's ``select distinct`` + left join + CASE).
    """
    lk = _keys(left_on)
    rk = _keys(right_on or left_on)
    marks = right.select(*[F.col(r).alias(l) for l, r in zip(lk, rk)]).distinct() \
        .withColumn("__mark", F.lit(True))
    return (left.join(marks, lk, "left")
            .withColumn(name, F.when(F.col("__mark"), F.lit(yes)).otherwise(F.lit(no)))
            .drop("__mark"))


def exclude(left: DataFrame, right: DataFrame, left_on, right_on=None) -> DataFrame:
    """Anti-join (the reference's left join + ``IS NULL`` or 0/1 flag + outer filter)."""
    lk = _keys(left_on)
    rk = _keys(right_on or left_on)
    cond = [left[l] == right[r] for l, r in zip(lk, rk)]
    return left.join(right, cond, "left_anti")


def restrict(left: DataFrame, right: DataFrame, left_on, right_on=None) -> DataFrame:
    """Semi-join: keep left rows whose key is in ``right``; duplicates in ``right`` never multiply."""
    lk = _keys(left_on)
    rk = _keys(right_on or left_on)
    cond = [left[l] == right[r] for l, r in zip(lk, rk)]
    return left.join(right, cond, "left_semi")


def same_day_join(fact: DataFrame, snap: DataFrame, keys: Sequence[str], day: str = "day",
                  how: str = "left") -> DataFrame:
    """Join a fact row to the snapshot row of the same day (``fact.day = snapshot.day``)."""
    return fact.join(snap, [*keys, day], how)


def state_intervals(snap: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Daily snapshots (keys, day, other columns: the state) as intervals: (keys, state, valid_from, valid_to), both ends
    included, one row per run of days without a gap and without a change.

    A table of states has a row per change instead of one a day; the days of one key are the only window."""
    state = [c for c in snap.columns if c not in (*keys, day)]
    by_day = Window.partitionBy(*keys).orderBy(day)
    last = F.lag(F.struct(F.col(day).alias("d"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(state)])).over(by_day)
    now = F.struct(F.date_sub(F.col(day), 1).alias("d"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(state)])
    runs = snap.distinct().withColumn("_new", F.when(last.eqNullSafe(now), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(by_day))
    return runs.groupBy(*keys, *state, "_run").agg(F.min(day).alias("valid_from"), F.max(day).alias("valid_to")).drop("_run")


def valid_on(fact: DataFrame, states: DataFrame, keys: Sequence[str], day: str = "day", how: str = "left",
             by_month: tuple | None = None) -> DataFrame:
    """Same-day snapshot join against interval-coded states: each fact row gets the state of its key whose
    ``valid_from`` .. ``valid_to`` (both included, null: open) holds the row's day.  States of a key must not overlap.

    An equi-join on the keys; the day is tested inside the join, so nothing is multiplied by days.  For keys with
    very many states, ``by_month`` = (first, last day of the facts) also deals both sides by month, so a fact row meets
    only the states of its month."""
    on, st = list(keys), states
    if by_month:
        first, last = (F.lit(x).cast("date") for x in by_month)
        st = st.withColumn("_from", F.greatest(F.coalesce("valid_from", first), first)).withColumn("_to", F.least(F.coalesce("valid_to", last), last))
        months = F.sequence(F.trunc("_from", "MM"), F.trunc("_to", "MM"), F.expr("interval 1 month"))
        st = st.where(F.col("_from") <= F.col("_to")).withColumn("_month", F.explode(months)).drop("_from", "_to")
        fact, on = fact.withColumn("_month", F.trunc(day, "MM")), [*on, "_month"]
    f, s = fact.alias("f"), st.alias("s")
    d = F.col(f"f.{day}")
    cond = (F.col("s.valid_from").isNull() | (d >= F.col("s.valid_from"))) & (F.col("s.valid_to").isNull() | (d <= F.col("s.valid_to")))
    if not by_month:  # a row without a day has no state
        cond = cond & d.isNotNull()
    for k in on:
        cond = cond & (F.col(f"f.{k}") == F.col(f"s.{k}"))
    carried = [F.col(f"s.{c}") for c in st.columns if c not in (*on, "valid_from", "valid_to")]
    return f.join(s, cond, how).select(*[F.col(f"f.{c}") for c in fact.columns if c != "_month"], *carried)
