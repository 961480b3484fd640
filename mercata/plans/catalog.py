"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator / job key.

Outputs are normalised at the edge: money DECIMAL -> DOUBLE, 8/16/32-bit integers -> BIGINT, so
results compare 1:1 with the SQL in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.functions.numeric import report_round
from mercata.params import Params
from mercata.plans import accounts as acct
from mercata.plans import follow_up as follow
from mercata.plans import ledger, primitives
from mercata.plans import segmentation as seg
from mercata.plans import sql_form
from mercata.plans import status
from mercata.plans import top_owners as top
from mercata.sources.tables import Tables

P = Params()
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Output types at the edge: DECIMAL -> DOUBLE, narrow integers -> BIGINT (one projection)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str):
    def deco(fn: Callable[[SparkSession, Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, Tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- top owners
@register("gross_by_cell")
def _gross(spark, t):
    return top.gross_by_cell(t, P.top)


@register("refund_by_cell")
def _refund(spark, t):
    return top.refund_by_cell(t, P.top)


@register("net_gmv_monthly")
def _net_monthly(spark, t):
    return top.net_gmv_monthly(t, P.top)


@register("join_full_outer_net")
def _full_outer_net(spark, t):
    return top.net_gmv_full_outer(top.gross_by_cell(t, P.top), top.refund_by_cell(t, P.top))


@register("net_gmv_annual")
def _net_annual(spark, t):
    return top.net_gmv_annual(top.net_gmv_monthly(t, P.top), P.top)


@register("gmv_pivot_recent")
def _pivot_recent(spark, t):
    return top.gmv_pivot_recent(spark, top.net_gmv_monthly(t, P.top), P.top)


@register("gmv_pivot_months")
def _pivot_months(spark, t):
    return top.gmv_pivot_months(top.net_gmv_monthly(t, P.top), P.top)


@register("gmv_pivot_type")
def _pivot_type(spark, t):
    return top.gmv_pivot_type(top.net_gmv_monthly(t, P.top))


@register("rating_quality")
def _quality(spark, t):
    q = top.rating_quality(t, P.top)
    return q.withColumn("share", report_round("share"))


@register("rating_quality_3m")
def _quality_3m(spark, t):
    q = top.rating_quality(t, P.top, recent=True)
    return q.withColumn("share", report_round("share"))


@register("rating_qualified")
def _rating_qualified(spark, t):
    return top.rating_qualified(t, P.top).withColumn("share", report_round("share"))


@register("gmv_qualified")
def _gmv_qualified(spark, t):
    return top.gmv_qualified(top.net_gmv_monthly(t, P.top), top.rating_qualified(t, P.top), P.top)


@register("top_categories")
def _top_categories(spark, t):
    return top.top_categories(top.net_gmv_monthly(t, P.top), P.top)


@register("top_owner_report")
def _top_owner_report(spark, t):
    return top.top_owner_report(t, P.top)


# ---------------------------------------------------------------- segmentation
def _r4(df, *cols):
    for c in cols:
        df = df.withColumn(c, report_round(c))
    return df


_PROFILE_ORDER = ["nip", "seller_id", "actual_account_status", "last_date_account_status", "company_history",
                  "seller_segment", "new_meta", "maincat", "yesterday", "sum_GMV", "avg_GMV", "avg_count_deals",
                  "avg_count_offers", "min_date", "count_month_sales", "count_month_offers"]


@register("monthly_offer_panel")
def _offer_panel(spark, t):
    return seg.monthly_offer_panel(t, P.seg)


@register("monthly_sales_panel")
def _sales_panel(spark, t):
    return seg.monthly_sales_panel(t, P.seg)


@register("main_category")
def _main_category(spark, t):
    return seg.main_category(seg.monthly_sales_panel(t, P.seg))


@register("current_account_status")
def _current_status(spark, t):
    return seg.current_account_status(t)


@register("seller_profile")
def _seller_profile(spark, t):
    return _r4(seg.seller_profile(t, P.seg), "avg_count_deals", "avg_count_offers") \
        .select(*_PROFILE_ORDER).orderBy("seller_id")


@register("profile_with_total")
def _profile_total(spark, t):
    full = seg.profile_with_total(seg.seller_profile(t, P.seg))
    return _r4(full, "avg_count_deals", "avg_count_offers").select(*_PROFILE_ORDER)


@register("verified_owner_rollup")
def _owner_rollup(spark, t):
    r = seg.verified_owner_rollup(seg.profile_with_total(seg.seller_profile(t, P.seg)))
    return _r4(r, "avg_count_deals", "avg_count_offers")


def _thresholds(t):
    full = seg.profile_with_total(seg.seller_profile(t, P.seg))
    return seg.segment_thresholds(seg.verified_owner_rollup(full), P.seg)


@register("segment_thresholds")
def _segment_thresholds(spark, t):
    return _r4(_thresholds(t), "small", "medium", "large", "VIP")


@register("thresholds_long")
def _thresholds_long(spark, t):
    return _r4(seg.thresholds_long(_thresholds(t)), "quartile")


@register("assign_segment")
def _assign_segment(spark, t):
    return seg.assign_segment(t, P.seg)


# ---------------------------------------------------------------- status change
@register("yearly_status_change")
def _yearly(spark, t):
    return status.yearly_status_change(t, P.status).orderBy("seller_id", "year")


@register("status_change_summary")
def _status_summary(spark, t):
    return status.status_change_summary(status.yearly_status_change(t, P.status))


@register("status_change_share")
def _status_share(spark, t):
    s = status.status_change_share(status.status_change_summary(status.yearly_status_change(t, P.status)))
    return _r4(s, "share")


@register("status_head_sample")
def _status_head(spark, t):
    return status.head_sample(status.yearly_status_change(t, P.status))


@register("only_classified_sellers")
def _only_classified(spark, t):
    return status.only_classified_sellers(status.yearly_status_change(t, P.status), 2001)


# ---------------------------------------------------------------- accounts and owners
@register("account_enrichment")
def _account_enrichment(spark, t):
    return acct.account_enrichment(t, P.acct).orderBy("list_segment", "us_id")


@register("owner_active_offers")
def _owner_offers(spark, t):
    return acct.owner_active_offers(t, P.acct)


@register("owner_active_offers_sql")
def _owner_offers_sql(spark, t):
    return sql_form.owner_active_offers_sql(t, P.acct)


@register("attendee_enrichment")
def _attendees(spark, t):
    return acct.attendee_enrichment(t, P.acct)


@register("owner_activity_flags")
def _activity_flags(spark, t):
    return acct.owner_activity_flags(t, P.acct)


@register("active_owner_count")
def _active_count(spark, t):
    return acct.active_owner_count(acct.owner_activity_flags(t, P.acct))


@register("owner_last_login")
def _last_login(spark, t):
    return acct.owner_last_login(t, P.acct)


@register("owner_last_login_by_key_sets")
def _last_login_sets(spark, t):
    """The same report with the sellers of all history as monthly bitmaps."""
    return acct.owner_last_login(t, P.acct, acct.offer_key_sets(t, P.acct))


@register("login_recency_summary")
def _login_summary(spark, t):
    return acct.login_recency_summary(acct.owner_last_login(t, P.acct), P.acct)


# ---------------------------------------------------------------- ledger and follow-ups
@register("order_refund_ledger")
def _ledger(spark, t):
    return ledger.order_refund_ledger(t, P.ledger)


@register("fee_summary")
def _fees(spark, t):
    return follow.fee_summary(t, P.follow)


def _qualified_owners(t):
    """Owners qualified by the top-owner report, handed to the follow-ups as a DataFrame."""
    hub = top.net_gmv_monthly(t, P.top)
    return top.gmv_qualified(hub, top.rating_qualified(t, P.top), P.top).select("nip")


@register("fee_summary_qualified")
def _fees_qualified(spark, t):
    return follow.fee_summary(t, P.follow, owner_list=_qualified_owners(t))


@register("forecast_panel_qualified")
def _forecast_qualified(spark, t):
    return follow.forecast_panel(t, P.follow, owner_list=_qualified_owners(t)).orderBy("nip", "month")


@register("forecast_panel")
def _forecast(spark, t):
    return follow.forecast_panel(t, P.follow).orderBy("nip", "month")


# ---------------------------------------------------------------- single operators
def _primitive(name, fn):
    register(name)(lambda spark, t: fn(t))


for _name, _fn in primitives.QUERIES.items():
    _primitive(_name, _fn)
