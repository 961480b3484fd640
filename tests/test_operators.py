"""Operator semantics on small in-memory frames (edge cases the supplied data cannot show)."""

import random

import pytest
from pyspark.sql import functions as F

from mercata.functions.cases import case_ladder, decode, flag
from mercata.functions.numeric import half_even, report_round, round_half_up, safe_ratio
from mercata.operators import aggregates, joins, reshape, sets, windows
from mercata.operators.quantiles import exact_quantile


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def rows(df, *cols):
    """Collected rows as sorted tuples (NULLs last)."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (3.5,)], "x double")
    out = df.select("x", round_half_up("x", 0).alias("up"), half_even("x", 0).alias("even"))
    got = {r.x: (r.up, r.even) for r in out.collect()}
    assert got == {0.5: (1.0, 0.0), 1.5: (2.0, 2.0), 2.5: (3.0, 2.0), -2.5: (-3.0, -2.0), 3.5: (4.0, 4.0)}


def test_report_round_on_tie(spark):
    df = spark.createDataFrame([(2773758.51 / 8,)], "x double")
    assert df.select(report_round("x").alias("r")).first().r == 346719.8138


def test_report_rounds_once(spark):
    df = spark.createDataFrame([(0.12344999960,), (0.12345,), (-0.12345,), (0.12344999999999999,)], "x double")
    assert [r.r for r in df.select(report_round("x").alias("r")).collect()] == [0.1234, 0.1235, -0.1235, 0.1235]


def test_safe_ratio_zero_denominator(spark):
    z = spark.createDataFrame([(1, 0), (1, 2)], "n int, d int").select(safe_ratio("n", "d").alias("r"))
    assert sorted(r.r for r in z.collect() if r.r is not None) == [0.5]
    assert sum(r.r is None for r in z.collect()) == 1


def test_null_safe_inequality_keeps_null_status(spark):
    df = spark.createDataFrame([("company",), ("ver",), ("plain",), (None,)], "s string")
    unverified = df.where(~F.col("s").eqNullSafe("company") & ~F.col("s").eqNullSafe("ver"))
    assert rows(unverified, "s") == [("plain",), (None,)]
    assert df.where(F.col("s") != "company").count() == 2  # SQL <> drops NULL


def test_group_dropna(spark):
    df = spark.createDataFrame([("o1", "s1", 1.0), (None, "s1", 2.0), ("o1", None, 3.0)], "o string, s string, v double")
    g = aggregates.group_dropna(df, ["o", "s"]).groupBy("o", "s").agg(F.sum("v").alias("v"))
    assert rows(g, "o", "s", "v") == [("o1", "s1", 1.0)]


def test_existence_flag_sentinel_id_and_no_multiplication(spark):
    left = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    right = spark.createDataFrame([(0,), (0,), (2,)], "rid bigint")
    out = joins.existence_flag(left, right, "id", "rid", name="f")
    assert rows(out, "id", "f") == [(0, 1), (1, 0), (2, 1)]


def test_exclude_and_restrict(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    right = spark.createDataFrame([(2,), (2,), (None,)], "k bigint")
    assert rows(joins.exclude(left, right, "id", "k"), "id") == [(1,), (3,)]
    assert rows(joins.restrict(left, right, "id", "k"), "id") == [(2,)]


def test_with_total_keeps_unknown_category_out_of_total(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), (None, 4)], "cat string, v int")
    g = aggregates.with_total(df, "cat").groupBy("cat").agg(F.sum("v").alias("v"))
    assert rows(g, "cat", "v") == [("A", 1), ("B", 2), ("Total", 3), (None, 4)]


def test_lag_delta_over_year_gap(spark):
    df = spark.createDataFrame([(1, 2019, 0), (1, 2021, 1), (2, 2020, 1)], "s int, year int, v int")
    out = windows.lag_delta(df, ["s"], "year", "v", "d")
    assert rows(out, "s", "year", "d") == [(1, 2019, None), (1, 2021, 1), (2, 2020, None)]


def test_rank_ties_share_rank(spark):
    df = spark.createDataFrame([("o", "A", 5.0), ("o", "A", 5.0), ("o", "B", 1.0)], "o string, m string, g double")
    r = windows.ranked(df, ["o"], [F.desc("g"), F.asc("m")])
    assert sorted(x.ranking for x in r.collect()) == [1, 1, 3]


def test_share_of_group_sums_to_one(spark):
    df = spark.createDataFrame([(2020, 1), (2020, 3), (2021, 5)], "y int, n bigint")
    s = windows.share_of_group(df, ["y"], "n", "share")
    tot = s.groupBy("y").agg(F.sum("share").alias("t"))
    assert all(abs(r.t - 1.0) < 1e-12 for r in tot.collect())


def test_first_per_key_follows_order(spark):
    df = spark.createDataFrame([(1, 2021, "b"), (1, 2020, "a"), (2, 2022, "c")], "k int, y int, v string")
    out = windows.first_per_key(df, ["k"], [F.col("y")])
    assert rows(out, "k", "v") == [(1, "a"), (2, "c")]


def test_named_pivot_keeps_rows_with_unlisted_values(spark):
    df = spark.createDataFrame([("n1", "B2B", 1.0), ("n2", "XXX", 2.0)], "nip string, t string, g double")
    p = reshape.named_pivot(df, ["nip"], "t", ["B2B", "B2C"], F.sum("g"), "gmv_")
    assert set(p.columns) == {"nip", "gmv_B2B", "gmv_B2C"}
    assert rows(p, "nip", "gmv_B2B", "gmv_B2C") == [("n1", 1.0, None), ("n2", None, None)]


def test_unpivot_keeps_empty_cells(spark):
    m = spark.createDataFrame([("A", 1.0, None)], "cat string, small double, VIP double")
    long = reshape.unpivot_matrix(m, "cat", ["small", "VIP"], "segment", "q")
    assert rows(long, "segment", "q") == [("VIP", None), ("small", 1.0)]


def test_month_grid_is_entities_times_months(spark):
    import datetime as dt
    owners = spark.createDataFrame([("1",), ("2",), ("3",)], "nip string")
    g = reshape.with_months(owners, dt.date(2020, 11, 1), dt.date(2021, 2, 28))
    assert g.count() == 3 * 4
    assert rows(g.where("nip = '1'"), "month") == [("202011",), ("202012",), ("202101",), ("202102",)]
    spine = reshape.month_spine(spark, dt.date(2021, 5, 1), dt.date(2021, 7, 31))
    assert rows(spine, "month") == [("202105",), ("202106",), ("202107",)]


def test_case_helpers(spark):
    df = spark.createDataFrame([(1,), (4,), (9,), (None,)], "c int")
    out = df.select("c", decode(F.col("c"), {1: "small", 4: "VIP"}).alias("d"),
                    case_ladder([(F.col("c") >= 4, "hi"), (F.col("c") >= 1, "lo")], "none").alias("l"),
                    flag(F.col("c") > 3).alias("f"))
    got = {r.c: (r.d, r.l, r.f) for r in out.collect()}
    assert got == {1: ("small", "lo", 0), 4: ("VIP", "hi", 1), 9: (None, "hi", 1), None: (None, "none", 0)}


def test_unions(spark):
    a = spark.createDataFrame([("m", "A", 1.0)], "month string, cat string, g double")
    b = spark.createDataFrame([("m", 2.0)], "month string, g double")
    u = sets.union_by_name(a, b)
    assert rows(u, "cat", "g") == [("A", 1.0), (None, 2.0)]
    t = sets.union_tagged({"x": b, "y": b}, "typ")
    assert rows(t, "typ") == [("x",), ("y",)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_matches_percentile_with_hot_group(spark, q):
    random.seed(7)
    data = [("hot", float(random.randint(0, 500))) for _ in range(3000)]
    data += [(f"g{i % 40}", random.random() * 100) for i in range(6000)]
    data += [("one", 5.0), ("ties", 2.0), ("ties", 2.0), ("ties", 2.0), ("nulls", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(16)
    got = {r.g: r.q for r in exact_quantile(df, ["g"], "v", q, "q").collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", q).alias("q")).collect() if r.q is not None}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-9), k


def test_ties_are_one_row_of_the_quantile(spark):
    """90 % equal values: the quantile works on counted values, so the tied value is one row."""
    df = spark.range(20000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    q = exact_quantile(df, ["g"], "v", 0.95, "q")
    assert q.first().q == pytest.approx(df.agg(F.percentile("v", 0.95)).first()[0])
    counted = df.groupBy("g", "v").count()
    assert counted.where("v = 0").first()["count"] == 18001 and counted.count() == 2000


def test_exact_quantiles_of_several_probabilities(spark):
    from mercata.operators.quantiles import exact_quantiles
    random.seed(11)
    data = [("a" if i % 3 else "b", random.random() * 1000) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(12)
    qs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {r.g: (r.p10, r.p50, r.p90) for r in exact_quantiles(df, ["g"], "v", qs).collect()}
    want = df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()])
    for r in want.collect():
        assert got[r.g] == pytest.approx((r.p10, r.p50, r.p90), rel=1e-12)


def test_ordered_list_repeats_counted_values_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, "z")], "k int, t string")
    out = aggregates.counted(df, ["k"], "t").groupBy("k").agg(aggregates.ordered_list("t").alias("l"),
                                                              F.sum("_n").alias("n"))
    assert rows(out, "k", "l", "n") == [(1, "a, b, b", 4), (2, "z", 1)]


def _brute_quantile(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    lo = int(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


def test_ordered_code_is_the_order_of_doubles(spark):
    import math
    import random
    import struct

    from mercata.operators.quantiles import with_ordered_code
    rng = random.Random(5)
    vals = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    vals += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    vals += [x for k in range(-1070, 1023, 7) for x in (2.0 ** k, math.nextafter(2.0 ** k, 0), -(2.0 ** k))]
    vals = [v for v in vals if v == v]
    rows = with_ordered_code(spark.createDataFrame([(v,) for v in vals], "v double"), "v", "c").collect()
    bits = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [r.c for r in rows] == [bits(r.v) for r in rows]


def test_quantile_of_close_values_is_spread(spark):
    """Values within 0.05 %, and values next to zero: every refining level splits them."""
    from mercata.operators.quantiles import _SHIFTS, exact_quantiles, with_ordered_code
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "zero").otherwise("close").alias("g"),
                               F.when(F.col("id") % 3 == 0, F.pow(F.lit(10.0), -(F.col("id") % 3000) / 10)).otherwise(100_000 + F.col("id") * 0.0008).alias("v"))
    got = {r.g: (r.a, r.b) for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    vals = {}
    for r in df.collect():
        vals.setdefault(r.g, []).append(r.v)
    assert got == {g: (_brute_quantile(v, 0.25), _brute_quantile(v, 0.9)) for g, v in vals.items()}
    coded, code = with_ordered_code(df, "v"), F.col("_code")
    for above, shift in zip(_SHIFTS, [*_SHIFTS[1:], 0]):  # rows of the largest window of each refining level
        most = coded.groupBy("g", F.shiftright(code, above)).agg(F.count_distinct(F.shiftright(code, shift)).alias("n")).agg(F.max("n")).first()[0]
        assert most <= 1 << 14
    # a hot group's first level has far more than one bucket, its last window a small share of the 40,000 values
    last = coded.where("g = 'close'").groupBy(F.shiftright(code, _SHIFTS[-1])).count().agg(F.max("count")).first()[0]
    assert last < 40


def test_day_in_interval_equals_same_day_join(spark):
    import datetime as dt
    import random
    rng, day0 = random.Random(7), dt.date(2020, 1, 1)
    snap = sorted({(k, day0 + dt.timedelta(days=d)): (rng.choice(["a", "a", "b", None])) for k in range(12) for d in range(120) if rng.random() < 0.8}.items())
    snap = spark.createDataFrame([(k, d, s) for (k, d), s in snap], "k long, day date, state string")
    fact = spark.createDataFrame([(rng.choice([*range(14), None]), rng.choice([None, *(day0 + dt.timedelta(days=d) for d in range(-5, 130))]), i)
                                  for i in range(800)], "k long, day date, n long")
    want = sorted((tuple(r) for r in joins.same_day_join(fact, snap, ["k"]).select("k", "day", "n", "state").collect()), key=str)
    states = joins.state_intervals(snap.union(snap.limit(40)), ["k"])
    assert states.count() < snap.count()
    for by_month in (None, (dt.date(2019, 12, 1), dt.date(2020, 6, 1))):
        got = joins.valid_on(fact, states, ["k"], by_month=by_month)
        assert got.columns == ["k", "day", "n", "state"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_key_sets_merge_months_and_replace_one(spark, tmp_path):
    from mercata.operators import keysets
    from mercata.sources.sinks import write_parquet
    keys = [0, 1, 7, 32767, 32768, 32769, 65536, 10 ** 15, -5, None]
    rows = spark.createDataFrame([(k, "202001" if i % 2 else "202002") for i, k in enumerate(keys * 3)], "id long, m string")
    path = str(tmp_path / "sets")
    write_parquet(keysets.monthly_key_sets(rows, "id", F.col("m")), path, ["month"])
    asked = spark.createDataFrame([(k,) for k in [*keys, 2, 32770, 10 ** 15 + 1, -6, 99999, 0]], "id long")
    flags = lambda: [(r.id, r.seen) for r in keysets.existence_flag(asked, spark.read.parquet(path), "id", "seen").collect()]
    have = {k for k in keys if k is not None}
    assert sorted(flags(), key=str) == sorted(((r.id, int(r.id in have)) for r in asked.collect()), key=str)
    again = spark.createDataFrame([(99999, "202002")], "id long, m string")  # the running month is written anew
    write_parquet(keysets.monthly_key_sets(again, "id", F.col("m")), path, ["month"])
    kept = {k for i, k in enumerate(keys * 3) if i % 2 and k is not None} | {99999}
    assert sorted(flags(), key=str) == sorted(((r.id, int(r.id in kept)) for r in asked.collect()), key=str)
