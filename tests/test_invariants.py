"""
the dense panel is owners x months, every ranked owner has a first category, and the one-pass
owner ratings agree with the standalone rating queries."""

import pytest
from pyspark.sql import functions as F

from mercata.params import Params, month_keys
from mercata.plans import follow_up, status, top_owners
from mercata.sources import views as V
from mercata.sources.tables import Tables

SF = "/root/testdata/sf0.01"
P = Params()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_status_shares_sum_to_one_per_year(t):
    share = status.status_change_share(status.status_change_summary(status.yearly_status_change(t, P.status)))
    for r in share.groupBy("year").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1.0, abs=1e-12)


def test_month_pivot_resums_to_hub(t):
    hub = top_owners.net_gmv_monthly(t, P.top)
    piv = top_owners.gmv_pivot_months(hub, P.top)
    cols = [F.coalesce(F.col(f"gmv_{m}"), F.lit(0)) for m in P.top.pivot_months]
    total = piv.select("nip", sum(cols[1:], cols[0]).alias("s"))
    src = hub.where(F.col("month").isin(P.top.pivot_months)).groupBy("nip").agg(F.sum("gmv").alias("s"))
    got = {r.nip: float(r.s) for r in total.collect() if r.nip is not None}
    want = {r.nip: float(r.s) for r in src.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=0.01 * len(P.top.pivot_months))


def test_forecast_panel_is_owners_times_months(t):
    panel = follow_up.forecast_panel(t, P.follow)
    owners = V.owner_list(t).count()
    months = len(month_keys(P.follow.forecast_start, P.follow.forecast_stop))
    assert panel.count() == owners * months
    assert panel.select("nip", "month").distinct().count() == owners * months


def test_every_ranked_owner_has_a_first_category(t):
    hub = top_owners.net_gmv_monthly(t, P.top)
    ranks = top_owners.category_ranks(hub, P.top).where(F.col("nip").isNotNull())
    per_owner = ranks.groupBy("nip").agg(F.min("ranking").alias("best"), F.count_if(F.col("ranking") == 1).alias("firsts"))
    assert all(r.best == 1 and r.firsts >= 1 for r in per_owner.collect())


def test_one_pass_ratings_agree_with_standalone_queries(t):
    combined = {r.nip: r for r in top_owners.owner_ratings(t, P.top).collect()}
    whole = {r.nip: r.share for r in top_owners.rating_quality(t, P.top).collect()}
    recent = {r.nip: r.share for r in top_owners.rating_quality(t, P.top, recent=True).collect()}
    qualified = {r.nip: r.share for r in top_owners.rating_qualified(t, P.top).collect()}
    assert combined.keys() == whole.keys()
    for nip, r in combined.items():
        assert r.share == pytest.approx(whole[nip], abs=1e-12)
        assert (r.share_3m is None and recent.get(nip) is None) or r.share_3m == pytest.approx(recent[nip], abs=1e-12)
    assert {n for n, r in combined.items() if r.weighted_share is not None
            and r.weighted_share >= P.top.min_rating_share} == set(qualified)
    for nip, s in qualified.items():
        assert combined[nip].weighted_share == pytest.approx(s, abs=1e-12)


def test_wide_owner_aggregate_equals_pivots_and_annual(spark, t):
    hub = top_owners.net_gmv_monthly(t, P.top)
    wide = {r.nip: r.asDict() for r in top_owners.owner_wide(hub, P.top).collect()}
    parts = [top_owners.gmv_pivot_months(hub, P.top), top_owners.gmv_pivot_type(hub),
             top_owners.gmv_pivot_recent(spark, hub, P.top)]
    for part in parts:
        for r in part.collect():
            for c, v in r.asDict().items():
                if c != "nip":
                    assert wide[r.nip][c] == v, (r.nip, c)
    for r in top_owners.net_gmv_annual(hub, P.top).collect():
        assert wide[r.nip]["gmv12m"] == round(r.gmv, 2)
