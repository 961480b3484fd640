"""Single-operator queries: each exercises one library operator on the canonical views, for the
semantics the composed jobs only touch indirectly (null-safe filters, Total grain, union by
name, rounding modes, zero denominators, exact quantiles ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import month_key, month_number, year_of
from mercata.functions.numeric import half_even, report_round, round_half_up, safe_ratio
from mercata.operators import aggregates, joins, scans, sets, windows
from mercata.operators.aggregates import with_total
from mercata.operators.quantiles import exact_quantiles
from mercata.params import Params
from mercata.sources import views as V
from mercata.sources.tables import Tables

P = Params()


def scan_date_range(t: Tables) -> DataFrame:
    """Order lines of the report window, per day (the range reaches the parquet scan)."""
    s = scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop)
    return s.groupBy("day").agg(F.count(F.lit(1)).alias("lines"), F.sum("price").alias("gmv"))


def scan_day_snapshot(t: Tables) -> DataFrame:
    """The consent snapshot of one day."""
    c = scans.snapshot(V.consents(t), "day", P.acct.events_yesterday)
    return c.select("userid", "consentname", "channel", "approved")


def _current_status(t: Tables) -> DataFrame:
    return scans.current_rows(V.account_status_history(t), "cis_historical")


def filter_null_safe_not_equal(t: Tables) -> DataFrame:
    """Accounts per current status that is neither 'company' nor 'ver'; NULL status is kept."""
    s = _current_status(t)
    s = s.where(~F.col("cis_status").eqNullSafe("company") & ~F.col("cis_status").eqNullSafe("ver"))
    return s.groupBy("cis_status").agg(F.count(F.lit(1)).alias("accounts"))


def filter_drops_nulls(t: Tables) -> DataFrame:
    """Accounts per current status <> 'company' (SQL inequality: NULL status is dropped)."""
    s = _current_status(t).where(F.col("cis_status") != "company")
    return s.groupBy("cis_status").agg(F.count(F.lit(1)).alias("accounts"))


def existence_flag(t: Tables) -> DataFrame:
    """Every account with a 0/1 'has ever sold' mark (account 0 is a real id, not a sentinel)."""
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"))
    return joins.existence_flag(accounts, V.sales(t), "account_id", "seller_id", name="is_seller")


def restrict_to_list(t: Tables) -> DataFrame:
    """Accounts of listed owners (semi-join: a repeated list entry never multiplies rows)."""
    accounts = joins.restrict(V.owner_map(t), V.owner_list(t), "nip")
    return accounts.groupBy("nip").agg(F.count(F.lit(1)).alias("accounts"))


def _window_sales_by_meta(t: Tables) -> DataFrame:
    s = scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop)
    tree = V.category_tree(t)
    return s.join(tree, s.category_id == tree.ca_id_leaf, "left")


def grouping_total(t: Tables) -> DataFrame:
    """Monthly GMV per meta category and for all categories ('Total') in one aggregation."""
    s = with_total(_window_sales_by_meta(t), "new_meta")
    return s.groupBy(month_key("day").alias("month"), "new_meta").agg(
        F.sum("price").alias("gmv"), F.count(F.lit(1)).alias("lines"))


def union_by_name(t: Tables) -> DataFrame:
    """Per-category monthly GMV stacked with the monthly total, which has no category column."""
    s = _window_sales_by_meta(t).withColumn("month", month_key("day"))
    per_cat = s.groupBy("month", "new_meta").agg(F.sum("price").alias("gmv"))
    total = s.groupBy("month").agg(F.sum("price").alias("gmv"))
    return sets.union_by_name(per_cat, total)


def group_quantile(t: Tables) -> DataFrame:
    """Lower quartile and median of seller GMV per meta category (exact, interpolated)."""
    g = _window_sales_by_meta(t).groupBy("seller_id", "new_meta").agg(F.sum("price").alias("gmv"))
    q = exact_quantiles(g, ["new_meta"], "gmv", {"q1": 0.25, "median": 0.5})
    return q.select("new_meta", report_round("q1").alias("q1"), report_round("median").alias("median"))


def lag_delta(t: Tables) -> DataFrame:
    """Yearly GMV per seller and its change against the seller's previous present year."""
    g = V.sales(t).groupBy("seller_id", year_of("day").alias("year")).agg(F.sum("price").alias("gmv"))
    return windows.lag_delta(g, ["seller_id"], "year", "gmv", "gmv_change")


def round_modes(t: Tables) -> DataFrame:
    """Mean line quantity per seller and year, rounded half-up (SQL) and half-even (pandas)."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("seller_id"), year_of("l_shipdate").alias("year")) \
        .agg(F.avg("l_quantity").alias("avg_quantity"))
    return g.select("seller_id", "year", report_round("avg_quantity").alias("avg_quantity"),
                    round_half_up("avg_quantity", 0).alias("half_up"),
                    half_even("avg_quantity", 0).alias("half_even"))


def safe_ratio_daily(t: Tables) -> DataFrame:
    """Purchases per error event per user and day; NULL when the day had no error."""
    e = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.withColumn("ratio", report_round(safe_ratio("purchases", "errors")))


def scan_open_range(t: Tables) -> DataFrame:
    """Net GMV since a date (open-ended range), per account."""
    g = scans.open_range(V.net_gmv_daily(t), "dt", P.acct.gmv_open_from)
    daily = g.groupBy("account_id", "dt").agg(F.sum("GMV_ref").alias("gmv"))
    return daily.groupBy("account_id").agg(F.count("dt").alias("days"), F.sum("gmv").alias("gmv"))


def scan_trailing_30d(t: Tables) -> DataFrame:
    """Net GMV of the 30 days ending yesterday (both ends included), per account."""
    g = scans.trailing_days(V.net_gmv_daily(t), "dt", P.acct.sales_yesterday, P.acct.gmv_days)
    return g.groupBy("account_id").agg(F.sum("GMV_ref").alias("gmv_30d"))


def filter_in_list(t: Tables) -> DataFrame:
    """Approved consents of chosen names and channels (IN lists), accounts per name and channel."""
    c = V.consents(t).where(F.col("approved") & F.col("consentname").isin(V.CONSENT_MARKETING, V.CONSENT_TESTING)
                            & F.col("channel").isin("PHONE"))
    return c.groupBy("consentname", "channel").agg(F.count_distinct("userid").alias("accounts"))


def filter_multi(t: Tables) -> DataFrame:
    """Large lines (conjunction of range, quantity and price predicates) per seller."""
    s = scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop)
    s = s.where((F.col("quantity") >= 45) & (F.col("price") >= 50000))
    return s.groupBy("seller_id").agg(F.count(F.lit(1)).alias("lines"))


def join_same_day(t: Tables) -> DataFrame:
    """Offers of days on which the seller was verified (fact day = snapshot day), per month."""
    o = V.offers_total(t, P.seg.date_from, P.seg.date_to)
    v = V.verified_sellers(t, P.seg.date_from, P.seg.date_to) \
        .select(F.col("account_id").alias("seller_id"), "day", F.lit(1).alias("verified_day"))
    j = joins.same_day_join(o, v, ["seller_id"], "day")
    return j.groupBy(month_key("day").alias("month")).agg(
        F.sum("offers").alias("offers"),
        F.sum(F.when(F.col("verified_day") == 1, F.col("offers")).otherwise(0)).alias("verified_offers"))


def join_day_in_interval(t: Tables) -> DataFrame:
    """``join_same_day`` against interval-coded states (one row per run of verified days), dealt by month."""
    o = V.offers_total(t, P.seg.date_from, P.seg.date_to)
    v = V.verified_sellers(t, P.seg.date_from, P.seg.date_to) \
        .select(F.col("account_id").alias("seller_id"), "day", F.lit(1).alias("verified_day"))
    j = joins.valid_on(o, joins.state_intervals(v, ["seller_id"]), ["seller_id"], "day", by_month=(P.seg.date_from, P.seg.date_to))
    return j.groupBy(month_key("day").alias("month")).agg(
        F.sum("offers").alias("offers"),
        F.sum(F.when(F.col("verified_day") == 1, F.col("offers")).otherwise(0)).alias("verified_offers"))


def join_month_key(t: Tables) -> DataFrame:
    """Offers by the seller's segment of the month (derived yyyymm joined to the stored month)."""
    o = V.offers_total(t, P.seg.date_from, P.seg.date_to).withColumn("month_", month_number("day"))
    seg = V.segment_monthly(t, P.seg.date_from, P.seg.date_to) \
        .select(F.col("us_id").alias("seller_id"), "month_", "segment")
    j = o.join(seg, ["seller_id", "month_"], "left")
    return j.groupBy("month_", "segment").agg(F.sum("offers").alias("offers"))


def exclude_test_accounts(t: Tables) -> DataFrame:
    """Monthly GMV of the window without test accounts (anti-join)."""
    s = joins.exclude(scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop),
                      V.test_users(t), "seller_id", "us_id")
    return s.groupBy(month_key("day").alias("month")).agg(F.sum("price").alias("gmv"))


def left_join_filtered_right(t: Tables) -> DataFrame:
    """Refunds per month, split by whether their order lies in the window (predicate on the right
    side of a left join, so no refund is lost)."""
    r = V.refunds(t, P.top.date_start, P.top.date_stop)
    h = V.order_headers(t, P.top.date_start, P.top.date_stop).select("order_offer_id", F.lit(1).alias("in_window"))
    j = r.join(h, "order_offer_id", "left")
    return j.groupBy(month_key("day").alias("month")).agg(
        F.count(F.lit(1)).alias("refunds"), F.count("in_window").alias("with_order_in_window"))


def agg_basic(t: Tables) -> DataFrame:
    """Sum / mean / min / max / count of line prices per seller in the window."""
    s = scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop)
    return s.groupBy("seller_id").agg(
        F.sum("price").alias("gmv"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.count(F.lit(1)).alias("lines"), F.min("day").alias("first_day"))


def agg_distinct(t: Tables) -> DataFrame:
    """Distinct offers, days and months per seller (exact distinct counts)."""
    s = scans.date_range(V.sales(t), "day", P.top.date_start, P.top.date_stop)
    return s.groupBy("seller_id").agg(F.count_distinct("offer_id").alias("offers"),
                                      F.count_distinct("day").alias("days"),
                                      F.count_distinct(month_key("day")).alias("months"))


def group_nunique(t: Tables) -> DataFrame:
    """Number of distinct meta categories sold per seller in the window."""
    return _window_sales_by_meta(t).groupBy("seller_id").agg(F.count_distinct("new_meta").alias("categories"))


def group_drop_null_keys(t: Tables) -> DataFrame:
    """Current accounts per status and owner, rows with a NULL status not forming a group."""
    s = _current_status(t).join(V.owner_map(t), F.col("cis_user_id") == F.col("ud_us_id"))
    s = aggregates.group_dropna(s, ["cis_status", "nip"])
    return s.groupBy("cis_status", "nip").agg(F.count(F.lit(1)).alias("accounts"))


def share_of_group(t: Tables) -> DataFrame:
    """Share of each meta category in the month's GMV."""
    g = _window_sales_by_meta(t).groupBy(month_key("day").alias("month"), "new_meta") \
        .agg(F.sum("price").alias("gmv"))
    s = windows.share_of_group(g, ["month"], "gmv", "share")
    return s.withColumn("share", report_round("share"))


def distinct_rows(t: Tables) -> DataFrame:
    """Distinct verified (seller, day) pairs counted per month."""
    v = V.verified_sellers(t, P.seg.date_from, P.seg.date_to)
    return v.groupBy(month_key("day").alias("month")).agg(F.count(F.lit(1)).alias("seller_days"))


def dates_month_year(t: Tables) -> DataFrame:
    """Events per calendar year, month key and date."""
    e = t.events.select(F.to_date("ts").alias("day"))
    return e.groupBy(year_of("day").alias("year"), month_key("day").alias("month"), "day") \
        .agg(F.count(F.lit(1)).alias("events"))


QUERIES = {
    "scan_date_range": scan_date_range,
    "scan_day_snapshot": scan_day_snapshot,
    "filter_null_safe_not_equal": filter_null_safe_not_equal,
    "filter_drops_nulls": filter_drops_nulls,
    "existence_flag": existence_flag,
    "restrict_to_list": restrict_to_list,
    "grouping_total": grouping_total,
    "union_by_name": union_by_name,
    "group_quantile": group_quantile,
    "lag_delta": lag_delta,
    "round_modes": round_modes,
    "safe_ratio_daily": safe_ratio_daily,
    "scan_open_range": scan_open_range,
    "scan_trailing_30d": scan_trailing_30d,
    "filter_in_list": filter_in_list,
    "filter_multi": filter_multi,
    "join_same_day": join_same_day,
    "join_day_in_interval": join_day_in_interval,
    "join_month_key": join_month_key,
    "exclude_test_accounts": exclude_test_accounts,
    "left_join_filtered_right": left_join_filtered_right,
    "agg_basic": agg_basic,
    "agg_distinct": agg_distinct,
    "group_nunique": group_nunique,
    "group_drop_null_keys": group_drop_null_keys,
    "share_of_group": share_of_group,
    "distinct_rows": distinct_rows,
    "dates_month_year": dates_month_year,
}
