"""Exact sets of BIGINT keys as mergeable bitmaps, kept by month.

"Did this key ever occur?" over all history needs no second read of the history: a month's keys are a few
bitmaps (one row per 32,768 neighbouring ids), months are merged by ``or``, and a finished month never changes.
A daily run builds the bitmaps of the running month only and writes them over that month's folder
(``sinks.write_parquet(..., partition_by=["month"])``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monthly_key_sets(df: DataFrame, key: str, month: Column) -> DataFrame:
    """(month, bucket, bits): the distinct non-null keys of each month."""
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(month.alias("month"), F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged(sets: DataFrame) -> DataFrame:
    """(bucket, bits) of all months together."""
    return sets.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def existence_flag(left: DataFrame, sets: DataFrame, key: str, name: str = "flag", yes=1, no=0) -> DataFrame:
    """``name`` = yes if the key is in the sets else no (also for a null key); ``left`` is never multiplied."""
    place = F.bitmap_bit_position(key)
    sets = merged(sets).withColumnRenamed("bucket", "_bucket").withColumnRenamed("bits", "_bits")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2
    return (left.join(sets, F.bitmap_bucket_number(key) == F.col("_bucket"), "left")
            .withColumn(name, F.when(bit == 1, F.lit(yes)).otherwise(F.lit(no))).drop("_bucket", "_bits"))
