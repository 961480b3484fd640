"""Property checks on random inputs: the distributed exact quantile equals numpy's linear
percentile, and report rounding equals decimal half-up rounding of the shortest decimal form."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercata.functions.numeric import report_round
from mercata.operators.quantiles import exact_quantiles

groups = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-10_000, 10_000)),
                  min_size=1, max_size=300)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=groups, q=st.sampled_from([0.0, 0.25, 0.5, 0.73, 1.0]), parts=st.integers(1, 9))
def test_exact_quantile_equals_numpy(spark, rows, q, parts):
    df = spark.createDataFrame([(g, v / 7.0) for g, v in rows], "g string, v double").repartition(parts)
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", {"q": q}).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        want[g] = float(np.percentile([v / 7.0 for gg, v in rows if gg == g], q * 100, method="linear"))
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-9, abs=1e-9)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cents=st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=50), n=st.integers(1, 64))
def test_report_round_is_half_up_of_the_shortest_form(spark, cents, n):
    values = [c / 100 / n for c in cents]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.r for r in df.select(report_round("x").alias("r")).collect()]
    want = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
                  .quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in values]
    assert got == want


keys = st.tuples(st.sampled_from(["1", "2"]), st.sampled_from(["200101", "200102"]),
                 st.sampled_from(["A", "B", None]), st.sampled_from(["s", None]), st.sampled_from(["B2B", "B2C"]))
cells = st.dictionaries(keys, st.integers(-10**6, 10**6), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(orders=cells, refunds=cells)
def test_presence_flag_netting_equals_full_outer_join(spark, orders, refunds):
    from decimal import Decimal as Dec

    from mercata.plans import top_owners

    ddl = "nip string, month string, new_meta string, new_ca_name_1 string, order_type string"
    o = spark.createDataFrame([(*k, Dec(v) / 100) for k, v in orders.items()], ddl + ", gmv decimal(18,2)")
    r = spark.createDataFrame([(*k, Dec(v) / 100) for k, v in refunds.items()], ddl + ", ref_gmv decimal(18,2)")
    sides = o.selectExpr(*top_owners.CELL, "'o' AS side", "gmv AS amount").unionByName(
        r.selectExpr(*top_owners.CELL, "'r' AS side", "ref_gmv AS amount"))

    def rows(df):
        got = df.select("nip", "month", "order_type", "new_meta", "new_ca_name_1",
                        F.col("gmv").cast("double").alias("gmv")).collect()
        return sorted((tuple(x) for x in got), key=lambda t: tuple((v is None, str(v)) for v in t))

    assert rows(top_owners.net_cells(sides)) == rows(top_owners.net_gmv_full_outer(o, r))
