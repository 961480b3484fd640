"""Jobs run on tiny fixture tables that show what the supplied data cannot (FIXTURES.md §4)."""

import datetime as dt

from pyspark.sql import functions as F

from mercata.params import AccountParams, FollowUpParams, StatusParams, TopOwnerParams
from mercata.plans import accounts, follow_up, primitives, status, top_owners

TS = dt.datetime


def test_refund_only_cell_and_null_category_not_netted(make_tables):
    t = make_tables(
        customer=[(1, "c1", 5, 10.0, "AUTOMOBILE"), (2, "c2", 7, 10.0, "BUILDING")],
        orders=[(100, 2, "O", 0.0, TS(1990, 1, 1), "x"), (101, 1, "O", 0.0, TS(2001, 1, 2), "x")],
        part=[(10, "p10", "B1", "A", 1, 1.0), (11, "p11", "B2", None, 1, 1.0)],
        lineitem=[(100, 10, 1, 1, 1.0, 250.0, 0.0, 0.0, "R", "F", TS(2001, 1, 5)),
                  (101, 11, 1, 1, 1.0, 80.0, 0.0, 0.0, "R", "F", TS(2001, 1, 6))],
    )
    hub = top_owners.net_gmv_monthly(t, TopOwnerParams())
    got = sorted((tuple(r) for r in hub.select("nip", "month", "order_type", "new_meta", "new_ca_name_1",
                                                  F.col("gmv").cast("double")).collect()),
                 key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got == [
        ("5", "200101", "B2C", None, "B2", 80.0),     # NULL category never nets its refund
        (None, None, "B2C", None, "B2", None),
        (None, None, "B2C", None, None, None),        # refund of an order before the window: no category, no type
    ]


def test_refund_is_netted_only_through_an_order_of_the_window(make_tables):
    customer = [(1, "c1", 5, 10.0, "AUTOMOBILE"), (2, "c2", 7, 10.0, "BUILDING")]
    part = [(10, "p10", "B1", "A", 1, 1.0)]

    def hub(order_day):
        t = make_tables(
            customer=customer, part=part,
            orders=[(100, 2, "O", 0.0, order_day, "x"), (101, 2, "O", 0.0, TS(2001, 1, 2), "x")],
            lineitem=[(100, 10, 1, 1, 1.0, 30.0, 0.0, 0.0, "R", "F", TS(2001, 1, 20)),
                      (101, 10, 1, 1, 1.0, 100.0, 0.0, 0.0, "N", "F", TS(2001, 3, 5))])
        p = TopOwnerParams()
        rows = top_owners.net_gmv_monthly(t, p)
        literal = top_owners.net_gmv_full_outer(top_owners.gross_by_cell(t, p), top_owners.refund_by_cell(t, p))
        cells = [sorted(((r.nip, r.month, r.order_type, r.new_meta, r.gmv and float(r.gmv)) for r in d.collect()), key=str)
                 for d in (rows, literal)]
        assert cells[0] == cells[1]
        return cells[0]

    # the sale counts in the month of its order; the refund of the same month and cell comes off
    assert hub(TS(2001, 1, 10)) == [("5", "200101", "B2B", "A", 100.0)]
    # an order before the window: its refund has no category and no buyer type and comes off nothing
    assert hub(TS(1990, 1, 10)) == [("5", "200101", "B2B", "A", 100.0), (None, None, "B2C", None, None)]


def test_buyer_type_is_that_of_the_order_day(spark, make_tables):
    """A buyer who became a company on 10 January 2001: orders and refunds follow the day of the order."""
    t = make_tables(
        customer=[(1, "c1", 5, 10.0, "AUTOMOBILE"), (2, "c2", 7, 10.0, "AUTOMOBILE")], part=[(10, "p10", "B1", "A", 1, 1.0)],
        orders=[(100, 2, "O", 0.0, TS(2001, 1, 9), "x"), (101, 2, "O", 0.0, TS(2001, 1, 10), "x"), (102, 9, "O", 0.0, TS(2001, 1, 11), "x")],
        lineitem=[(100, 10, 1, 1, 1.0, 30.0, 0.0, 0.0, "R", "F", TS(2001, 1, 20)), (101, 10, 1, 1, 1.0, 100.0, 0.0, 0.0, "N", "F", TS(2001, 3, 5)),
                  (101, 10, 1, 1, 1.0, 7.0, 0.0, 0.0, "R", "F", TS(2001, 1, 30)), (102, 10, 1, 1, 1.0, 5.0, 0.0, 0.0, "N", "F", TS(2001, 3, 5))])
    day = dt.date
    history = spark.createDataFrame([(2, "private", None, day(2001, 1, 9)), (2, "company", day(2001, 1, 10), None)],
                                    "account_id long, account_type string, valid_from date, valid_to date")
    p = TopOwnerParams()
    cells = lambda df, c: sorted((r.month, r.order_type, float(r[c])) for r in df.collect())
    assert cells(top_owners.gross_by_cell(t, p, history), "gmv") == [("200101", "B2B", 107.0), ("200101", "B2C", 35.0)]
    assert cells(top_owners.refund_by_cell(t, p, history), "ref_gmv") == [("200101", "B2B", 7.0), ("200101", "B2C", 30.0)]
    assert cells(top_owners.net_gmv_monthly(t, p, history), "gmv") == [("200101", "B2B", 100.0), ("200101", "B2C", 5.0)]
    assert cells(top_owners.gross_by_cell(t, p), "gmv") == [("200101", "B2C", 142.0)]  # the supplied single state


def test_hub_scans_refunds_by_date_and_filters_lines_by_order_keys(spark):
    from mercata.sources.tables import Tables
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        t = Tables(spark, "/root/testdata/sf0.01")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan(top_owners.refund_lines(t, TopOwnerParams())).splitlines() if "l_returnflag" in x and "PushedFilters" in x]
        assert lines and all("GreaterThanOrEqual(l_shipdate,2000-08-01" in x for x in lines)
        assert "might_contain" in plan(top_owners.gross_lines(t, TopOwnerParams()))
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_last_login_and_offers_know_nothing_after_their_day(make_tables):
    day = dt.date(2024, 1, 10)
    t = make_tables(
        customer=[(3, "c3", 9, 1.0, "MACHINERY")],
        events=[(1, TS(2024, 1, 10, 8), 3, "signup", 1.0, "{}"), (2, TS(2024, 1, 30, 23), 3, "view", 1.0, "{}")],
        lineitem=[(100, 10, 3, 1, 1.0, 30.0, 0.0, 0.0, "N", "F", TS(2001, 9, 20))])
    p = AccountParams(events_yesterday=day, sales_yesterday=dt.date(2001, 8, 30))
    (r,) = accounts.owner_last_login(t, p).collect()
    assert (r.nip, r.max_log, r.ever_offer, r.accounts) == ("9", TS(2024, 1, 10, 8), 0, 1)
    (r,) = accounts.owner_last_login(t, AccountParams(events_yesterday=day, sales_yesterday=dt.date(2001, 9, 20))).collect()
    assert r.ever_offer == 1


def test_head_sample_cuts(spark):
    yearly = spark.createDataFrame([(s, y) for s in (2, 1, 3) for y in (2000, 1999)], "seller_id long, year int")
    assert [tuple(r) for r in status.head_sample(yearly, 3).collect()] == [(1, 1999), (1, 2000), (2, 1999)]


def test_rank_tie_gives_two_first_rows(spark):
    p = TopOwnerParams()
    hub = spark.createDataFrame(
        [("1", "200101", "B2C", "A", "s1", 10.0), ("1", "200101", "B2C", "A", "s2", 10.0),
         ("1", "200102", "B2C", "B", "s3", 5.0)],
        "nip string, month string, order_type string, new_meta string, new_ca_name_1 string, gmv double")
    top = top_owners.top_categories(hub, p)
    assert sorted((r.new_meta, r.new_ca_name_1, r.second_new_meta) for r in top.collect()) == \
        [("A", "s1", "B"), ("A", "s2", "B")]


def test_month_outside_pivot_list_keeps_row(spark):
    p = TopOwnerParams()
    hub = spark.createDataFrame([("9", "199901", "B2C", "A", "s", 1.0), ("8", "200012", "B2B", "A", "s", 2.0)],
                                "nip string, month string, order_type string, new_meta string, "
                                "new_ca_name_1 string, gmv double")
    piv = top_owners.gmv_pivot_months(hub, p)
    assert len(piv.columns) == 1 + len(p.pivot_months)
    r = {x.nip: x for x in piv.collect()}
    assert all(r["9"][f"gmv_{m}"] is None for m in p.pivot_months)
    assert r["8"]["gmv_200012"] == 2.0


def test_all_null_opinions_give_null_share(make_tables):
    t = make_tables(customer=[(3, "c3", 9, 1.0, "MACHINERY")],
                    events=[(1, TS(2024, 1, 5, 10), 3, "view", 1.0, "{}"), (2, TS(2024, 1, 6), 3, "view", 1.0, "{}")])
    q = top_owners.rating_quality(t, TopOwnerParams()).collect()
    assert [(r.nip, r.positive, r.rated, r.share) for r in q] == [("9", 0, 0, None)]


def test_attendee_unknown_to_accounts(make_tables):
    t = make_tables(customer=[(1, "c1", 5, 1.0, "AUTOMOBILE")],
                    events=[(1, TS(2024, 1, 5), 1, "signup", 60.0, "{}"), (2, TS(2024, 1, 6), 99, "signup", 1.0, "{}")])
    p = AccountParams()
    assert [r.id for r in accounts.attendee_enrichment(t, p).collect()] == [1]
    kept = accounts.attendee_enrichment(t, p, keep_unmatched=True).collect()
    assert sorted((r.account_name, r.id) for r in kept) == [("acct-1", 1), ("acct-99", None)]


def test_year_gap_lag_and_first_year_fill(make_tables):
    # seller 1: verified rule (l_linestatus 'F' and (seller + year) % 3 <> 0) holds in 1999, not in 1997
    t = make_tables(lineitem=[(1, 5, 1, 1, 30.0, 1.0, 0.0, 0.0, "N", "F", TS(1997, 3, 1)),
                              (2, 5, 1, 1, 30.0, 1.0, 0.0, 0.0, "N", "F", TS(1999, 3, 1))])
    y = status.yearly_status_change(t, StatusParams())
    assert sorted((r.year, r.verified, r.verified_status) for r in y.collect()) == [(1997, 0, None), (1999, 1, 1)]
    s = status.status_change_summary(y)
    assert sorted((r.year, r.verified_status, r.verified_status_desc) for r in s.collect()) == \
        [(1997, 0, "no change"), (1999, 1, "regular -> company")]


def test_sentinel_id_zero_is_a_real_account(make_tables):
    t = make_tables(customer=[(0, "c0", 1, 1.0, "X"), (1, "c1", 1, 1.0, "X")],
                    lineitem=[(1, 5, 0, 1, 1.0, 1.0, 0.0, 0.0, "N", "F", TS(2000, 1, 1))])
    got = sorted((r.account_id, r.is_seller) for r in primitives.existence_flag(t).collect())
    assert got == [(0, 1), (1, 0)]


def test_fee_totals_zero_negative_dropped_or_kept(make_tables):
    # gross = value - 50: user 1 nets to 0 (dropped), user 2 is negative (kept)
    t = make_tables(customer=[(1, "c1", 1, 1.0, "X"), (2, "c2", 1, 1.0, "X")],
                    nation=[(1, "n1", 1)],
                    events=[(1, TS(2024, 1, 2), 1, "click", 40.0, "{}"), (3, TS(2024, 1, 3), 1, "click", 60.0, "{}"),
                            (5, TS(2024, 1, 4), 2, "click", 10.0, "{}"), (7, TS(2024, 1, 4), 2, "error", 99.0, "{}")])
    out = follow_up.fee_summary(t, FollowUpParams()).collect()
    assert [(r.nip, r.short_type, float(r.amount)) for r in out] == [("1", "click", -40.0)]


def test_unknown_leaf_gets_null_group_and_no_total(make_tables):
    t = make_tables(part=[(10, "p", "B", "A", 1, 1.0)],
                    lineitem=[(1, 10, 1, 1, 1.0, 5.0, 0.0, 0.0, "N", "F", TS(2001, 1, 1)),
                              (2, 77, 1, 1, 1.0, 7.0, 0.0, 0.0, "N", "F", TS(2001, 1, 1))])
    got = sorted(((r.new_meta, float(r.gmv)) for r in primitives.grouping_total(t).collect()),
                 key=lambda r: (r[0] is None, r))
    assert got == [("A", 5.0), ("Total", 5.0), (None, 7.0)]


def test_forecast_grid_is_complete_and_gaps_are_zero(make_tables):
    t = make_tables(nation=[(1, "n1", 1), (3, "n3", 3), (2, "n2", 2)],
                    customer=[(5, "c5", 1, 1.0, "X")],
                    lineitem=[(1, 9, 5, 1, 1.0, 10.0, 0.0, 0.0, "N", "F", TS(2001, 8, 3)),
                              (2, 9, 5, 1, 1.0, 20.0, 0.0, 0.0, "R", "F", TS(2001, 7, 3))])
    p = FollowUpParams(forecast_start=dt.date(2001, 6, 1), forecast_stop=dt.date(2001, 8, 31))
    rows = {(r.nip, r.month): (r.offers, float(r.gmv)) for r in follow_up.forecast_panel(t, p).collect()}
    assert len(rows) == 2 * 3  # owners of regions 1 and 3 x three months
    assert rows[("1", "200108")] == (1.0, 10.0)
    assert rows[("1", "200107")] == (1.0, 0.0)   # only a returned line: offers but no net GMV
    assert rows[("1", "200106")] == (0.0, 0.0)
    assert rows[("3", "200108")] == (0.0, 0.0)


def test_ratings_weighted_by_verified_days(make_tables):
    # Every event is a rating ('error' negative, others positive); 'signup' days are verified days.
    # Account 4 (owner 2): 3 verified days, 5 ratings (4 positive); account 5 (owner 2): 1 day, 1 positive.
    ev = [(1, TS(2024, 1, 2), 4, "signup", 1.0, "{}"), (2, TS(2024, 1, 3), 4, "signup", 1.0, "{}"),
          (3, TS(2024, 1, 4), 4, "click", 1.0, "{}"), (4, TS(2024, 1, 4), 4, "error", 1.0, "{}"),
          (5, TS(2024, 1, 9), 5, "signup", 1.0, "{}"), (6, TS(2024, 1, 6), 4, "signup", 1.0, "{}")]
    t = make_tables(customer=[(4, "c4", 2, 1.0, "X"), (5, "c5", 2, 1.0, "X")], events=ev)
    p = TopOwnerParams(min_rating_share=0.0)
    # each rating counts once per verified day of its account: (4*3 + 1) / (5*3 + 1)
    q = top_owners.rating_qualified(t, p).collect()
    assert [(r.nip, round(r.share, 6)) for r in q] == [("2", round(13 / 16, 6))]
    u = top_owners.rating_quality(t, p).collect()
    assert [(r.nip, r.positive, r.rated) for r in u] == [("2", 5, 6)]


def test_empty_quantile_cell_falls_through_the_ladder(spark):
    from mercata.params import SegmentationParams
    from mercata.plans import segmentation
    p = SegmentationParams()
    rollup = spark.createDataFrame(
        [("1", "small", "A", 10.0, 5.0, 1.0), ("2", "small", "A", 30.0, 5.0, 1.0),
         ("3", "VIP", "A", 99.0, 1.0, 1.0),          # below the VIP deal limit: the VIP cell stays empty
         ("4", "small", "B", 7.0, 0.5, 1.0)],        # below the small limit: category B has no cell at all
        "nip string, seller_segment string, new_meta string, avg_GMV double, avg_count_deals double, "
        "avg_count_offers double")
    m = {r.new_meta: r for r in segmentation.segment_thresholds(rollup, p).collect()}
    assert set(m) == {"A", "B"}
    assert m["A"].small == 15.0 and m["A"].VIP is None and m["A"].medium is None
    assert m["B"].small is None
    probe = spark.createDataFrame([("A", 20.0, 10.0), ("A", 5.0, 10.0), ("B", 1e9, 1e9)],
                                  "new_meta string, avg_GMV double, avg_count_deals double")
    j = probe.join(segmentation.segment_thresholds(rollup, p), "new_meta", "left") \
        .withColumn("seg", segmentation._ladder(p))
    assert sorted((r.new_meta, r.avg_GMV, r.seg) for r in j.collect()) == \
        [("A", 5.0, "lack"), ("A", 20.0, "small"), ("B", 1e9, "lack")]


def test_forecast_gmv_on_spine_option(make_tables):
    t = make_tables(nation=[(1, "n1", 1)], customer=[(5, "c5", 1, 1.0, "X")],
                    lineitem=[(1, 9, 5, 1, 1.0, 10.0, 0.0, 0.0, "N", "F", TS(2001, 8, 3))])
    p = FollowUpParams(forecast_start=dt.date(2001, 8, 1), forecast_stop=dt.date(2001, 8, 31))
    a = {(r.nip, r.month): float(r.gmv) for r in follow_up.forecast_panel(t, p).collect()}
    b = {(r.nip, r.month): float(r.gmv) for r in follow_up.forecast_panel(t, p, join_gmv_on_spine=True).collect()}
    assert a == b == {("1", "200108"): 10.0}
