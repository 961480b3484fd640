"""A hot key holding a third of the rows: with broadcasts off and AQE skew splitting forced, the
hub and the quantile give the same answer as the default plan, and the split really happens."""

import datetime as dt
import random

import pytest

from mercata.params import TopOwnerParams
from mercata.plans import primitives, top_owners

TS = dt.datetime

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(make_tables):
    random.seed(3)
    n = 3000
    customers = [(i, f"c{i}", i % 25, 1.0, "BUILDING" if i % 4 == 0 else "MACHINERY") for i in range(200)]
    parts = [(p, f"p{p}", f"Brand#{p % 5}", ["A", "B", "C"][p % 3], 1, 1.0) for p in range(50)]
    orders, lines = [], []
    for k in range(n):
        hot = k % 3 == 0                       # a third of all lines: seller 7, buyer 11
        seller = 7 if hot else random.randrange(200)
        buyer = 11 if hot else random.randrange(200)
        day = TS(2000, 8, 1) + dt.timedelta(days=random.randrange(390))
        orders.append((k, buyer, "O", 0.0, day - dt.timedelta(days=random.randrange(60)), "x"))
        lines.append((k, random.randrange(50), seller, 1, float(random.randint(1, 50)),
                      float(random.randint(100, 100000)) / 100, 0.0, 0.0,
                      "R" if k % 5 == 0 else "N", "F", day))
    return make_tables(customer=customers, part=parts, orders=orders, lineitem=lines)


def _collect(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_hub_under_forced_skew_split(spark, skewed):
    p = TopOwnerParams()
    baseline = _collect(top_owners.net_gmv_monthly(skewed, p))
    saved = {k: spark.conf.get(k, None) for k in FORCED}
    try:
        for k, v in FORCED.items():
            spark.conf.set(k, v)
        df = top_owners.gross_by_cell(skewed, p)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        forced = _collect(top_owners.net_gmv_monthly(skewed, p))
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "skew=true" in plan
    assert forced == baseline


def test_quantile_with_hot_group_matches_brute_force(spark, skewed):
    from pyspark.sql import functions as F
    got = {r.new_meta: (r.q1, r.median) for r in primitives.group_quantile(skewed).collect()}
    g = primitives._window_sales_by_meta(skewed).groupBy("seller_id", "new_meta").agg(F.sum("price").alias("gmv"))
    want = g.groupBy("new_meta").agg(F.percentile(F.col("gmv").cast("double"), 0.25).alias("q1"),
                                     F.percentile(F.col("gmv").cast("double"), 0.5).alias("median"))
    want = {r.new_meta: (round(r.q1, 4), round(r.median, 4)) for r in want.collect()}
    assert got.keys() == want.keys() and len(got) == 3
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-4)
