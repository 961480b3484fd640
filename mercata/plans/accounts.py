"""Account and owner activity reports: list enrichment, owner offers, webinar attendees,
activity flags, last logins and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.cases import any_flag, decode, flag
from mercata.functions.dates import month_key
from mercata.functions.numeric import round_half_up
from mercata.operators import joins, keysets, scans
from mercata.operators.aggregates import counted, ordered_list
from mercata.params import SEGMENTS, AccountParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

SEGMENT_CODES = {i + 1: s for i, s in enumerate(SEGMENTS)}


def _consent_users(t: Tables, day, name: str, channels=None) -> DataFrame:
    c = scans.snapshot(V.consents(t), "day", day).where(F.col("approved") & (F.col("consentname") == name))
    if channels:
        c = c.where(F.col("channel").isin(*channels))
    return c.select("userid")


def account_enrichment(t: Tables, p: AccountParams) -> DataFrame:
    """Account list + profile, 30-day GMV, offers yesterday and two consent flags.

    As in the report, offers are joined through the GMV row's account, so accounts without GMV
    in the 30 days show no offers.
    """
    users = V.users(t).select("account_id", "login", "account_status", "account_type")
    base = V.account_list(t)
    base = base.join(users, base.us_id == users.account_id, "left").drop("account_id")
    g = scans.trailing_days(V.net_gmv_daily(t), "dt", p.sales_yesterday, p.gmv_days) \
        .groupBy("account_id").agg(F.sum("GMV_ref").alias("gmv"))
    gmv = g.join(V.account_list(t).select("us_id"), g.account_id == F.col("us_id")).groupBy("us_id") \
        .agg(F.sum("gmv").alias("gmv_30dni"))
    offers = scans.snapshot(V.offers_total(t), "day", p.sales_yesterday) \
        .select(F.col("seller_id").alias("gmv_us_id"), "offers")
    out = base.join(gmv.withColumn("gmv_us_id", F.col("us_id")), "us_id", "left")
    out = out.join(offers, "gmv_us_id", "left").drop("gmv_us_id")
    out = joins.existence_flag(out, _consent_users(t, p.events_yesterday, V.CONSENT_MARKETING, ["PHONE"]),
                               "us_id", "userid", name="consent_marketing_phone", yes="yes", no="no")
    out = joins.existence_flag(out, _consent_users(t, p.events_yesterday, V.CONSENT_TESTING, ["EMAIL"]),
                               "us_id", "userid", name="consent_testing_email", yes="yes", no="no")
    return out


def owner_active_offers(t: Tables, p: AccountParams, owner_list: DataFrame | None = None) -> DataFrame:
    """Active offers yesterday summed per listed owner."""
    lst = owner_list if owner_list is not None else V.owner_list(t)
    o = scans.snapshot(V.offers_total(t), "day", p.sales_yesterday)
    o = o.join(V.owner_map(t), o.seller_id == F.col("ud_us_id"))
    o = o.join(lst, "nip")
    return o.groupBy("nip").agg(F.sum("offers").alias("offers"))


def attendee_enrichment(t: Tables, p: AccountParams, keep_unmatched: bool = False) -> DataFrame:
    """Webinar attendees with login, owner, sales history since a date, offer flag and titles.

    The report right-joined attendees to the account snapshot and then filtered on the snapshot
    day, which drops attendees unknown to the snapshot; ``keep_unmatched`` keeps them.
    """
    att = V.webinar_attendance(t)
    logins = att.select("id", "account_name").distinct()
    webinars = counted(att, ["id"], "webinar_title").groupBy("id").agg(
        F.sum("_n").alias("attendances"),
        ordered_list("webinar_title").alias("webinar_titles"),
        F.min("webinar_title").alias("webinar_title"))
    # one row per account and day first: the day count is then a plain count
    daily = scans.open_range(V.net_gmv_daily(t), "dt", p.gmv_open_from).groupBy("account_id", "dt").agg(
        F.sum("GMV_ref").alias("gmv"), F.count("GMV_ref").alias("n"))
    g = daily.groupBy("account_id").agg(
        F.min("dt").alias("first_sale_date"),
        F.count("dt").alias("days_with_sales"),
        F.sum("gmv").alias("sum_gmv"),
        (F.sum("gmv") / F.sum("n")).cast("decimal(22,6)").alias("avg_gmv"))
    users = V.users(t).select("account_id", "login", "account_create_date")
    owner = V.owner_map(t).select(F.col("ud_us_id").alias("account_id"), "nip")
    base = logins.join(users, logins.id == users.account_id, "left" if keep_unmatched else "inner")
    base = base.join(owner, "account_id", "left").join(g, "account_id", "left")
    offers = scans.snapshot(V.offers_total(t), "day", p.sales_yesterday).select("seller_id")
    base = joins.existence_flag(base, offers, "account_id", "seller_id", name="have_offer_yesterday",
                                yes="yes", no="no")
    base = base.join(webinars, "id", "left")
    return base.select(
        "login", F.col("account_id").alias("id"), "nip", "account_name", "account_create_date",
        "first_sale_date", "days_with_sales",
        round_half_up("sum_gmv", 2).alias("sum_GMV_ref"),
        round_half_up("avg_gmv", 2).alias("daily_avg_GMV"),
        "have_offer_yesterday", "webinar_titles", "webinar_title", "attendances")


def _not_test(df: DataFrame, t: Tables, key: str) -> DataFrame:
    return joins.exclude(df, V.test_users(t), key, "us_id")


def owner_activity_flags(t: Tables, p: AccountParams) -> DataFrame:
    """Owner x segment of accounts verified on the activity day: any marketing consent on that
    day, any active offer yesterday (0/1); test accounts excluded."""
    v = scans.snapshot(V.verified_accounts(t), "day", p.activity_day).select("account_id")
    v = _not_test(v, t, "account_id")
    v = v.join(V.owner_map(t).select(F.col("ud_us_id").alias("account_id"), "nip"), "account_id", "left")
    seg = V.segment_monthly(t, p.activity_day, p.activity_day).where(F.col("month_") == p.activity_month) \
        .select(F.col("us_id").alias("account_id"), "segment")
    v = v.join(seg, "account_id", "left")
    v = joins.existence_flag(v, _consent_users(t, p.activity_day, V.CONSENT_MARKETING), "account_id", "userid",
                             name="marketing")
    offers = scans.snapshot(V.offers_total(t), "day", p.sales_yesterday).groupBy("seller_id") \
        .agg(F.sum("offers").alias("offers"))
    v = v.join(offers, v.account_id == offers.seller_id, "left") \
        .withColumn("offers", F.coalesce("offers", F.lit(0)))
    return v.groupBy("nip", "segment").agg(
        any_flag("marketing").alias("marketing"),
        any_flag("offers").alias("active_yesterday")) \
        .withColumn("segment_desc", decode(F.col("segment"), SEGMENT_CODES)) \
        .select("nip", "segment", "segment_desc", "marketing", "active_yesterday")


def active_owner_count(flags: DataFrame) -> DataFrame:
    """Number of owner x segment rows with an active offer yesterday."""
    return flags.where(F.col("active_yesterday") == 1).agg(F.count(F.lit(1)).alias("rows"))


def offer_key_sets(t: Tables, p: AccountParams) -> DataFrame:
    """Sellers with an offer, by month up to yesterday, as mergeable bitmaps."""
    return keysets.monthly_key_sets(V.offers_total(t, until=p.sales_yesterday), "seller_id", month_key("day"))


def owner_last_login(t: Tables, p: AccountParams, offer_sets: DataFrame | None = None) -> DataFrame:
    """Accounts verified yesterday (no test accounts) per owner and 'ever had an offer' up to yesterday:
    last successful login up to yesterday and number of accounts.

    With ``offer_sets`` (``offer_key_sets``, kept by month) the offers of all history are not read."""
    v = scans.snapshot(V.verified_accounts(t), "day", p.events_yesterday).select("account_id")
    v = _not_test(v, t, "account_id")
    v = v.join(V.owner_map(t).select(F.col("ud_us_id").alias("account_id"), "nip"), "account_id", "left")
    v = v.join(V.last_logins(t, p.events_yesterday), "account_id", "left")
    if offer_sets is not None:
        v = keysets.existence_flag(v, offer_sets, "account_id", "ever_offer")
    else:
        ever = scans.distinct_keys(V.offers_total(t, until=p.sales_yesterday), "seller_id")
        v = joins.existence_flag(v, ever, "account_id", "seller_id", name="ever_offer")
    return v.groupBy("nip", "ever_offer").agg(
        F.max("success_login_timestamp").alias("max_log"),
        F.count("account_id").alias("accounts"))


def login_recency_summary(last_login: DataFrame, p: AccountParams) -> DataFrame:
    """(ever-offer, logged in since the cutoff): owners and accounts; no login = never."""
    never = F.lit(p.login_never).cast("timestamp_ntz")
    cutoff = F.lit(p.login_cutoff).cast("timestamp_ntz")
    d = last_login.withColumn("recent_login", flag(F.coalesce("max_log", never) >= cutoff))
    return d.groupBy("ever_offer", "recent_login").agg(
        F.count("nip").alias("owners"), F.sum("accounts").alias("accounts"))
