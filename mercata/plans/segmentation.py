"""Seller segmentation: monthly offer / sales panels, seller profile per category and in total,
quartile thresholds learnt from verified sellers, new segment for the unverified ones.

The analyst ran the SQL twice (per category, then with every category relabelled 'Total') and
stacked the CSVs in pandas.  Here both grains come from one pass: ``with_total`` doubles each
daily row whose category is known before the first aggregate, so the daily sum, the monthly
average and every later join are shared.  pandas null rules are reproduced where they matter:
NULL status counts as unverified, group keys with NULL are dropped, ``round(0)`` is half-even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.functions.cases import case_ladder, decode
from mercata.functions.dates import month_key, month_number
from mercata.functions.numeric import half_even
from mercata.operators import joins, reshape, scans, windows
from mercata.operators.quantiles import exact_quantile
from mercata.operators.aggregates import group_dropna, with_total
from mercata.params import SEGMENTS, TOTAL_LABEL, VERIFIED_STATUSES, SegmentationParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

TOTAL = TOTAL_LABEL
SEGMENT_CODES = {i + 1: s for i, s in enumerate(SEGMENTS)}


def _not_total(c: str = "new_meta"):
    return ~F.col(c).eqNullSafe(TOTAL)


def monthly_offer_panel(t: Tables, p: SegmentationParams) -> DataFrame:
    """(month, seller, category | Total, segment): mean of daily offers (rounded) and first day.

    The segment label is set only on days the seller is verified (same-day snapshot join) and
    comes from the monthly segment table (month-key join).
    """
    o = V.offers_by_category(t, p.date_from, p.date_to)
    tree = V.category_tree(t).select("ca_id_leaf", "new_meta")
    o = o.join(tree, o.category_leaf == tree.ca_id_leaf, "left")
    ver = V.verified_sellers(t, p.date_from, p.date_to) \
        .select(F.col("account_id").alias("seller_id"), "day", F.lit(True).alias("verified"))
    o = joins.same_day_join(o, ver, ["seller_id"], "day")
    seg = V.segment_monthly(t, p.date_from, p.date_to).select(F.col("us_id").alias("seller_id"), "month_", "segment")
    o = o.withColumn("month_", month_number("day")).join(seg, ["seller_id", "month_"], "left")
    label = F.when(F.col("verified"), decode(F.col("segment"), SEGMENT_CODES))
    o = o.withColumn("seller_segment", label)
    daily = with_total(o, "new_meta", TOTAL) \
        .groupBy("day", "seller_id", "new_meta", "seller_segment").agg(F.sum("offers").alias("offers"))
    return daily.groupBy(month_key("day").alias("year_month"), "seller_id", "new_meta", "seller_segment").agg(
        F.round(F.avg("offers"), 0).alias("offers"), F.min("day").alias("min_date"))


def monthly_sales_panel(t: Tables, p: SegmentationParams) -> DataFrame:
    """(month, seller, category | Total): GMV and number of deals, test accounts excluded."""
    s = joins.exclude(V.sales(t, p.date_from, p.date_to), V.test_users(t), "seller_id", "us_id")
    # lines are summed per leaf category first; the category tree then sees one row per leaf
    s = s.groupBy(month_key("day").alias("year_month"), "seller_id", "category_id").agg(
        F.sum("price").alias("GMV"), F.count("offer_id").alias("count_deals"))
    tree = V.category_tree(t).select("ca_id_leaf", "new_meta")
    s = s.join(tree, s.category_id == tree.ca_id_leaf, "left")
    s = with_total(s, "new_meta", TOTAL)
    return s.groupBy("year_month", "seller_id", "new_meta").agg(
        F.sum("GMV").alias("GMV"), F.sum("count_deals").alias("count_deals"))


def main_category(sales_panel: DataFrame) -> DataFrame:
    """Category with the highest GMV per seller (RANK, ties broken by name; ties at rank 1 stay)."""
    g = sales_panel.where(_not_total()).groupBy("seller_id", "new_meta").agg(F.sum("GMV").alias("gmv"))
    r = windows.ranked(g, ["seller_id"], [F.desc("gmv"), F.asc("new_meta")])
    return r.where("ranking = 1").select("seller_id", F.col("new_meta").alias("maincat"))


def current_account_status(t: Tables) -> DataFrame:
    """Current status row per account + whether the account was ever 'company'."""
    h = V.account_status_history(t)
    ever = h.where(F.col("cis_status") == "company").select("cis_user_id")
    cur = scans.current_rows(h, "cis_historical")
    return joins.existence_flag(cur, ever, "cis_user_id", name="company").drop("cis_historical")


def seller_profile(t: Tables, p: SegmentationParams) -> DataFrame:
    """Per owner, seller, status, segment, category (| Total): GMV sums / means over months,
    mean deals and offers, first day, active yesterday, months with sales / offers."""
    offers = monthly_offer_panel(t, p)
    # feeds the join and the main-category ranking; the adaptive plan reuses its exchange
    sales = monthly_sales_panel(t, p)
    orders = sales.withColumn("sales_month", F.col("year_month"))
    j = offers.join(orders, ["seller_id", "new_meta", "year_month"], "left")
    status = current_account_status(t).select(
        F.col("cis_user_id").alias("seller_id"), F.col("cis_status").alias("actual_account_status"),
        F.col("cis_from_date").alias("last_date_account_status"), F.col("company").alias("company_history"))
    j = j.join(status, "seller_id", "left")
    yesterday = scans.snapshot(V.offers_by_category(t), "day", p.yesterday)
    j = joins.existence_flag(j, yesterday, "seller_id", name="yesterday")
    j = j.join(main_category(sales), "seller_id", "left")
    owner = V.owner_map(t).select(F.col("ud_us_id").alias("seller_id"), "nip")
    j = j.join(owner, "seller_id", "left")
    return j.groupBy("nip", "seller_id", "actual_account_status", "last_date_account_status", "company_history",
                     "seller_segment", "new_meta", "maincat", "yesterday").agg(
        F.sum("GMV").alias("sum_GMV"),
        F.avg("GMV").alias("avg_GMV"),
        F.avg("count_deals").alias("avg_count_deals"),
        F.avg("offers").alias("avg_count_offers"),
        F.min("min_date").alias("min_date"),
        # the panel has one row a month and group
        F.count("sales_month").alias("count_month_sales"),
        F.count("year_month").alias("count_month_offers"),
    )


FILL_ZERO = ("avg_GMV", "avg_count_deals", "avg_count_offers", "yesterday", "count_month_sales",
             "count_month_offers")


def profile_with_total(profile: DataFrame) -> DataFrame:
    """Per-category and Total rows with the main category and missing metrics set to 0."""
    return profile.fillna(0, subset=list(FILL_ZERO))


def _is_verified():
    return F.col("actual_account_status").isin(*VERIFIED_STATUSES)


def verified_owner_rollup(full: DataFrame) -> DataFrame:
    """Verified sellers (status company / ver) rolled up to owner x segment x category."""
    keys = ["nip", "seller_segment", "new_meta"]
    v = group_dropna(full.where(_is_verified()), keys)
    return v.groupBy(*keys).agg(
        F.sum("avg_GMV").alias("avg_GMV"),
        F.sum("avg_count_deals").alias("avg_count_deals"),
        F.avg("avg_count_offers").alias("avg_count_offers"),
    )


def segment_thresholds(rollup: DataFrame, p: SegmentationParams, every_category: bool = True) -> DataFrame:
    """Category x segment matrix: lower quartile of owner GMV among owners whose deal count
    reaches the segment's limit (exact, linearly interpolated quantile; empty cell = NULL).
    Without ``every_category``, categories with empty cells only are left out."""
    limit = decode(F.col("seller_segment"), p.limits)
    cells = rollup.where(F.col("avg_count_deals") >= limit)
    q = exact_quantile(cells, ["new_meta", "seller_segment"], "avg_GMV", p.quantile, "q")
    matrix = q.groupBy("new_meta").pivot("seller_segment", list(SEGMENTS)).agg(F.first("q"))
    if not every_category:
        return matrix
    return rollup.select("new_meta").distinct().join(matrix, "new_meta", "left")


def thresholds_long(matrix: DataFrame) -> DataFrame:
    """The threshold matrix as (category, segment, quartile) rows, empty cells kept."""
    return reshape.unpivot_matrix(matrix, "new_meta", list(SEGMENTS), "segment", "quartile")


def _ladder(p: SegmentationParams):
    lim = p.limits
    gmv, deals = F.col("avg_GMV"), F.col("avg_count_deals")
    return case_ladder([((gmv >= F.col(s)) & (deals >= lim[s]), s) for s in reversed(SEGMENTS)], "lack")


def assign_segment(t: Tables, p: SegmentationParams) -> DataFrame:
    """New segment of unverified sellers (NULL status counts as unverified) from the thresholds."""
    full = profile_with_total(seller_profile(t, p))
    thresholds = segment_thresholds(verified_owner_rollup(full), p, every_category=False)
    unverified = full.where(~_is_verified() | F.col("actual_account_status").isNull())
    j = unverified.join(thresholds, "new_meta", "left").withColumn("new_segment", _ladder(p))
    # a seller's rows are its categories by segment, a bounded window
    names = F.size(F.collect_set(F.when(_not_total(), F.col("new_meta"))).over(Window.partitionBy("seller_id")))
    j = j.withColumn("category_count", F.when(names > 0, names.cast("long")))
    return j.select(
        "seller_id", "actual_account_status", "last_date_account_status", "company_history", "new_meta",
        "maincat", "sum_GMV", "min_date",
        half_even("avg_GMV", 0).alias("avg_GMV"),
        half_even("avg_count_deals", 0).alias("avg_count_deals"),
        half_even("avg_count_offers", 0).alias("avg_count_offers"),
        "yesterday", "count_month_sales", "count_month_offers", "new_segment", "category_count",
    )
