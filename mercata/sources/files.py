"""File sources: CSV exports read with a declared schema (never inferred).

``read_csv`` fails the job at the first bad row; ``read_csv_checked`` returns the good rows and, beside them, the bad
ones as they stand in the file with the reason, so they can be written to a quarantine folder and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True,
             date_columns: dict[str, str] | None = None) -> DataFrame:
    """Read CSV with an explicit DDL schema; ``date_columns`` maps text columns to a date format
    (``{"last_date_account_status": "yyyy-MM-dd"}``), parsed with ``to_date``."""
    df = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)
    for col, fmt in (date_columns or {}).items():
        df = df.withColumn(col, F.to_date(F.col(col), fmt))
    return df


BAD, FILE = "_bad_row", "_file"


def read_csv_checked(spark: SparkSession, path: str, schema: str, header: bool = True, date_columns: dict[str, str] | None = None,
                     required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV export.

    bad: (file, row, reason): rows with a wrong number of fields or a value that is not of the declared type, a
    date that is not in its format, or a null in a ``required`` column.  Every row is in exactly one of the two."""
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(f"{schema}, {BAD} string").option("header", header).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", BAD).option("enforceSchema", True).csv(path).withColumn(FILE, F.input_file_name())
    reasons = [F.when(F.col(BAD).isNotNull(), F.lit("malformed"))]
    for c, fmt in (date_columns or {}).items():
        parsed = F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date")
        reasons.append(F.when(F.col(c).isNotNull() & parsed.isNull(), F.lit(f"{c} is no date {fmt}")))
    reasons += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required or []]
    rows = rows.withColumn("_reason", F.coalesce(*reasons))
    as_read = F.coalesce(F.col(BAD), F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in names])))
    bad = rows.where(F.col("_reason").isNotNull()).select(F.col(FILE).alias("file"), as_read.alias("row"), F.col("_reason").alias("reason"))
    good = rows.where(F.col("_reason").isNull())
    for c, fmt in (date_columns or {}).items():
        good = good.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(fmt)).cast("date"))
    return good.select(*names), bad
