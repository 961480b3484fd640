"""Sinks and the CSV source: a job output written partitioned by month and read back with a schema."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercata.plans import follow_up
from mercata.sources.files import read_csv, read_csv_checked
from mercata.sources.sinks import write_csv, write_parquet
from mercata.sources.tables import Tables
from mercata.params import FollowUpParams

SF = "/root/testdata/sf0.001"


def test_parquet_and_csv_round_trip(spark, tmp_path):
    panel = follow_up.forecast_panel(Tables(spark, SF), FollowUpParams(
        forecast_start=dt.date(2001, 1, 1), forecast_stop=dt.date(2001, 6, 30)))
    expected = sorted((r.nip, r.month, r.offers, float(r.gmv)) for r in panel.collect())

    write_parquet(panel, str(tmp_path / "pq"), partition_by=["month"])
    back = spark.read.parquet(str(tmp_path / "pq"))
    assert sorted((r.nip, str(r.month), r.offers, float(r.gmv)) for r in back.collect()) == expected

    write_csv(panel, str(tmp_path / "csv"))
    csv = read_csv(spark, str(tmp_path / "csv"), "nip string, month string, offers double, gmv double")
    assert sorted((r.nip, r.month, r.offers, r.gmv) for r in csv.collect()) == expected


def test_partitioned_overwrite_leaves_the_session_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, month string")
    write_parquet(df, path, partition_by=["month"])
    write_parquet(df.where("month = 'b'").withColumn("v", df.v + 10), path, partition_by=["month"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "month").collect()) == [(1, "a"), (12, "b")]
    df.where("month = 'b'").write.mode("overwrite").partitionBy("month").parquet(path)  # a plain overwrite replaces all
    assert [tuple(r) for r in spark.read.parquet(path).select("v", "month").collect()] == [(2, "b")]


def test_csv_source_parses_dates(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("seller_id,last_date_account_status\n1,2021-03-04\n2,\n")
    df = read_csv(spark, str(p), "seller_id bigint, last_date_account_status string",
                  date_columns={"last_date_account_status": "yyyy-MM-dd"})
    got = sorted((r.seller_id, r.last_date_account_status) for r in df.collect())
    assert got == [(1, dt.date(2021, 3, 4)), (2, None)]


def test_cli_writes_a_job_partitioned_by_month(spark, tmp_path):
    from mercata.__main__ import main
    out = tmp_path / "fees"
    main(["fee_summary", "--tables", SF, "--out", str(out)])
    back = spark.read.parquet(str(out))
    assert {p.name for p in out.iterdir() if p.name.startswith("month=")} == {"month=202401"}
    assert back.count() > 0 and "amount" in back.columns


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_failed_run_leaves_every_month_and_a_rerun_replaces_one(spark, tmp_path, kind):
    write = {"parquet": write_parquet, "csv": write_csv}[kind]
    path = str(tmp_path / kind)

    def held():
        df = spark.read.parquet(path) if kind == "parquet" else read_csv(spark, path, "v int, month string")
        return sorted(tuple(r) for r in df.select("v", "month").collect())

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "v int, month string")
    write(df, path, partition_by=["month"])
    fails = df.withColumn("v", F.when(F.col("v") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("v") + 10))
    with pytest.raises(Exception, match="broken"):
        write(fails.repartition(3), path, partition_by=["month"])
    assert held() == [(1, "a"), (2, "b"), (3, "b")]
    write(df.where("v = 2").withColumn("v", F.col("v") + 10), path, partition_by=["month"])
    assert held() == [(1, "a"), (12, "b")]


def test_csv_quarantine_takes_bad_rows_and_keeps_the_others(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,name,day\n1,"a, b",2021-03-04\nx,c,2021-03-04\n2,d,04.03.2021\n3,e\n4,f,2021-03-05,more\n,g,2021-03-06\n5,,\n')
    good, bad = read_csv_checked(spark, str(p), "id bigint, name string, day string", date_columns={"day": "yyyy-MM-dd"}, required=["id"])
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a, b", dt.date(2021, 3, 4)), (5, None, None)]
    rows = {r.row: r.reason for r in bad.collect()}
    assert rows == {"x,c,2021-03-04": "malformed", "2,d,04.03.2021": "day is no date yyyy-MM-dd", "3,e": "malformed",
                    "4,f,2021-03-05,more": "malformed", ',g,2021-03-06': "id is missing"}
    assert all(r.file.endswith("in.csv") for r in bad.collect())
    assert good.count() + bad.count() == 7
    write_csv(bad, str(tmp_path / "quarantine"))
    assert read_csv(spark, str(tmp_path / "quarantine"), "file string, row string, reason string").count() == 5
