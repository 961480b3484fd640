"""Exact, linearly interpolated quantiles per group by radix selection: no task ever holds a group.

``F.percentile`` is exact but merges every distinct value of a group into one aggregation
buffer, and a window over a group runs the group in one task; a group holding a third of
the rows would sit on a single executor.  Here:

1. rows are counted per (group, value), so any number of ties is one row;
2. every distinct value has a 64-bit code whose order is that of the values (sign, exponent, mantissa);
3. the rows of a group are counted by the first ``FIRST`` bits of the code, and only the buckets that hold the ranks
   floor(p) and ceil(p), p = (n - 1) * q, are refined: their values are counted by ``DIGIT`` more bits, level by
   level, until ``DIGIT`` bits are left;
4. within the last buckets a running sum of counts in value order gives each value its range of ranks, and
   the two values are interpolated.

A window of a refining level or of step 4 has at most 2 ** DIGIT rows, however close the values lie together; that of
the first level has a row per bucket (1,024 for a factor of two).  Lazy: nothing runs while the plan is built.
Matches pandas ``quantile`` / Spark ``percentile`` / SQL ``quantile_cont`` (linear method); NaN sorts last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, DIGIT = 22, 14
_SHIFTS = list(range(64 - FIRST, 0, -DIGIT))  # bits below each level's bucket


def with_ordered_code(df: DataFrame, value: str, name: str = "_code") -> DataFrame:
    """df plus a BIGINT that orders doubles as their values do; equal codes only for equal values (0.0 and -0.0
    are equal).  Built in steps, so that each part is computed once."""
    v, a, e, m = (F.col(c) for c in (value, "_abs", "_exp", "_man"))
    df = df.withColumn("_abs", F.abs(v))
    df = df.withColumn("_exp", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a)))))
    half = F.floor(e / 2)
    df = df.withColumn("_man", a * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - e))  # both factors are exact
    # the logarithm may be off by one next to a power of two
    off = F.when((m < 1) & (e > -1022), -1).when(m >= 2, 1).otherwise(0)
    df = df.withColumn("_off", off)
    df = df.withColumn("_man", F.when(F.col("_off") < 0, m * 2).when(F.col("_off") > 0, m / 2).otherwise(m)).withColumn("_exp", e + F.col("_off"))
    one = F.lit(2.0 ** 52)
    size = F.when(F.isnan(v), F.lit(2048 * (1 << 52) - 1)).when(a == float("inf"), F.lit(2047 * (1 << 52))).when(
        m < 1, (m * one).cast("long")).otherwise((e + 1023) * F.lit(1 << 52) + ((m - 1) * one).cast("long"))
    df = df.withColumn("_size", size)
    code = F.when(v == 0, F.lit(0).cast("long")).when((v < 0) & ~F.isnan(v), -F.col("_size")).otherwise(F.col("_size"))
    return df.withColumn(name, code).drop("_abs", "_exp", "_man", "_off", "_size")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """One row per group with at least one non-NULL value: ``keys..., <name> for name in qs``."""
    keys = list(keys)
    values = with_ordered_code(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
                               .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "_v")

    def holds(first, size, rank):
        return (rank >= first) & (rank < first + size)

    def hit(buckets):
        """The buckets that hold a wanted rank, with the ranks they hold."""
        w = F.filter("_w", lambda w: holds(F.col("_offset"), F.col("_in"), F.floor(w["p"])) | holds(F.col("_offset"), F.col("_in"), F.ceil(w["p"])))
        return buckets.withColumn("_w", w).where(F.size("_w") > 0).select(*keys, "_b", "_offset", "_w")

    def inside(held, shift):
        """Values of the held buckets (few rows: Spark broadcasts them where they are small)."""
        right = held.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_b").alias("_r_b"), "_offset", "_w")
        # null-safe, so that no filter on the code is inferred below the counting and its exchange is reused
        same = [values[k].eqNullSafe(right[f"_r_{k}"]) for k in keys] + [F.shiftright(values["_code"], shift).eqNullSafe(right["_r_b"])]
        return values.join(right, same).select(*keys, "_v", "_c", "_code", F.col("_r_b").alias("_b"), "_offset", "_w")

    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("p")) for name, q in qs.items()])
    held = hit(values.groupBy(*keys, F.shiftright("_code", _SHIFTS[0]).alias("_b")).agg(F.sum("_c").alias("_in"))
               .withColumn("_n", F.sum("_in").over(group)).withColumn("_offset", F.coalesce(F.sum("_in").over(before), F.lit(0)))
               .withColumn("_w", wanted))
    for above, shift in zip(_SHIFTS, _SHIFTS[1:]):
        counts = inside(held, above).groupBy(*keys, "_b", F.shiftright("_code", shift).alias("_next"), "_offset", "_w").agg(F.sum("_c").alias("_in"))
        within = Window.partitionBy(*keys, "_b").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        held = hit(counts.withColumn("_offset", F.col("_offset") + F.coalesce(F.sum("_in").over(within), F.lit(0)))
                   .drop("_b").withColumnRenamed("_next", "_b"))
    within = Window.partitionBy(*keys, "_b").orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside(held, _SHIFTS[-1]).withColumn("_first", F.col("_offset") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    found = ranked.select(*keys, "_v", "_c", "_first", F.explode("_w").alias("_w")).select(
        *keys, F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"),
        F.when(holds(F.col("_first"), F.col("_c"), F.floor("_w.p")), F.col("_v")).alias("_lo"),
        F.when(holds(F.col("_first"), F.col("_c"), F.ceil("_w.p")), F.col("_v")).alias("_hi"))
    per_q = found.groupBy(*keys, "_name", "_p").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")) \
        .select(*keys, "_name", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_p") - F.floor("_p"))).alias("_q"))
    return per_q.groupBy(*keys).pivot("_name", list(qs)).agg(F.first("_q"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """One row per group with at least one non-NULL value: ``keys..., name``."""
    return exact_quantiles(df, keys, value, {name: q})
