"""Driver contract: entry() smoke, key coverage, and Spark vs DuckDB on the smallest scale factor."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import tools.compare_oracle as co
from mercata.plans import catalog, oracle
from tools.compare_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:5] == ["nip", "rating_share", "rating_share_3m", "gmv12m", "new_meta"]


def test_every_query_has_oracle_sql():
    assert set(catalog.REGISTRY) == set(oracle.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_building_a_query_starts_no_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "plans only")
    try:
        for key in catalog.REGISTRY:
            entry.queries()[key](spark, SF)
        assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(catalog.REGISTRY))
def test_query_matches_oracle(spark, duck, key, monkeypatch):
    monkeypatch.setattr(co, "EXACT", True)   # floats compared bit for bit, declared types too
    problems, *_ = compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert not problems, problems
