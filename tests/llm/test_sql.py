"""Queries with SQL against DuckDB at the smallest size."""

import os

import duckdb
import pytest

from mercata.llm import queries
from tools.compare_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    problems, *_ = compare(spark, con, key, queries.QUERIES[key], queries.ORACLE[key], SF)
    assert not problems


def test_every_operator_has_one_query():
    names = [k.split("_")[0] for k in queries.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
