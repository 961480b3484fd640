"""Canonical views: the marketplace tables the jobs expect, bound to the supplied tables.

The analyst scripts read warehouse tables (daily offer snapshots, orders, refunds, account
history, consents, ratings, fees ...).  Each function below returns that logical table as a
lazy DataFrame derived from the TPC-H-like tables, so every job's work grows with the data.

Binding (one account-id space: customers; sellers are the customers that appear as
``l_suppkey``; event users are customers too):

===========================  =====================================================================
view                         derived from
===========================  =====================================================================
sales (orders fact)          lineitem [+ orders for the buyer]; day = ship date, price = line price
order_headers                orders: buyer and order day (the day both sides of the net-GMV hub go by)
refunds                      the returned lines of sales (flag 'R'); refund day = ship date
offers_by_category           lineitem: listed lines per (day, seller, leaf category = part)
offers_total                 lineitem: listed lines per (day, seller) + non-classified lines
verified_sellers             lineitem: (seller, day) with a finished line in a verified year
verified_accounts            events: (user, day) with a 'signup'
segment_monthly              (id, yyyymm) of sellers' lines and users' events; code = id % 4 + 1
                             (optionally bounded to a date range, so a job reads only its months)
category_tree                part: leaf = partkey, meta = p_type, level-1 name = p_brand
owner_map                    customer: account -> owner tax id (its nation key)
test_users                   customers with a negative balance (internal / test accounts)
account_status_history       customer: current row ('N') + an older 'company' row for id % 3 = 0
users                        customer + last login (max event time)
account_type_history         customer: account type with its days (one open interval an account)
consents                     events 'signup' / 'click' as marketing / testing-invite consents
net_gmv_daily                lineitem lines not returned, per seller and ship day
ratings                      events: 'view' = no opinion, 'error' = negative, else positive
fees / fee_types             events (type, value - 50) / fixed list of fee groups
owner_list                   nation keys of regions 1 and 3
account_list                 customers of the AUTOMOBILE segment
webinar_attendance           events 'signup': attendee id and a title per event
===========================  =====================================================================

Ids are normalised to BIGINT here (the warehouse mixed STRING and INT64 ids and cast at every
join); the owner tax id stays a STRING.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import day_of, month_number
from mercata.params import add_months
from mercata.sources.tables import Tables

MONEY = "decimal(18,2)"

# Fee type -> fee group ('error' has no group and is excluded by the fee report).
FEE_GROUPS = [
    ("view", "engagement"),
    ("click", "engagement"),
    ("signup", "acquisition"),
    ("purchase", "sales"),
    ("error", None),
]

# Consent names and channels of the consent snapshot.
CONSENT_MARKETING = "marketing"
CONSENT_TESTING = "testing-invites"


def _between(c: Column, start, stop) -> Column:
    return c.between(F.lit(start), F.lit(stop))


def sales(t: Tables, start=None, stop=None, with_buyer: bool = False) -> DataFrame:
    """Order lines by ship day.  ``with_buyer`` adds the buyer through the order header (an extra join)."""
    li = t.lineitem
    df = li.select(
        day_of("l_shipdate").alias("day"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_partkey").alias("offer_id"),
        F.col("l_orderkey").alias("deal_id"),
        F.col("l_orderkey").alias("order_offer_id"),
        F.col("l_partkey").alias("category_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.col("l_shipdate").alias("shipped_at"),
    )
    if start is not None:
        df = df.where(_between(F.col("day"), start, stop))
    if with_buyer:
        hdr = t.orders.select(
            F.col("o_orderkey").alias("deal_id"),
            F.col("o_custkey").alias("buyer_id"),
            F.col("o_orderdate").alias("buyingtime"),
        )
        df = df.join(hdr, "deal_id")
    return df


def order_headers(t: Tables, start=None, stop=None) -> DataFrame:
    df = t.orders.select(
        F.col("o_orderkey").alias("order_offer_id"),
        F.col("o_custkey").alias("buyer_id"),
        day_of("o_orderdate").alias("day"),
    )
    if start is not None:
        df = df.where(_between(F.col("day"), start, stop))
    return df


def refunds(t: Tables, start=None, stop=None, with_order_date: bool = False) -> DataFrame:
    """Refunds: the returned order lines, recorded on their ship day (derived from ``sales``, so the
    net-GMV hub's single pass over the lines and this view can never disagree)."""
    df = sales(t, start, stop).where(F.col("returned")).select(
        "day", "seller_id",
        F.col("deal_id").alias("order_id"),
        "offer_id", "order_offer_id", "category_id",
        F.col("quantity").alias("refund_quantity"),
        F.col("price").alias("refunded_gmv"),
        F.col("shipped_at").alias("refund_finish_date"),
    )
    if with_order_date:
        hdr = t.orders.select(F.col("o_orderkey").alias("order_id"),
                              F.col("o_orderdate").alias("order_buying_date"))
        df = df.join(hdr, "order_id")
    return df


def offers_by_category(t: Tables, start=None, stop=None) -> DataFrame:
    li = t.lineitem.select(day_of("l_shipdate").alias("day"),
                           F.col("l_suppkey").alias("seller_id"),
                           F.col("l_partkey").alias("category_leaf"))
    if start is not None:
        li = li.where(_between(F.col("day"), start, stop))
    return li.groupBy("day", "seller_id", "category_leaf").agg(F.count(F.lit(1)).alias("offers"))


def offers_total(t: Tables, start=None, stop=None, until=None) -> DataFrame:
    """Daily offer totals of a date range, or of all days up to ``until``."""
    li = t.lineitem.select(day_of("l_shipdate").alias("day"),
                           F.col("l_suppkey").alias("seller_id"),
                           F.col("l_quantity"))
    if start is not None:
        li = li.where(_between(F.col("day"), start, stop))
    if until is not None:
        li = li.where(F.col("day") <= F.lit(until))
    non_classified = ((F.col("seller_id") + F.year("day")) % 5 != 0) & (F.col("l_quantity") >= 25)
    return li.groupBy("day", "seller_id").agg(
        F.count(F.lit(1)).alias("offers"),
        F.count_if(non_classified).alias("offers_no_classifieds"),
    )


def verified_sellers(t: Tables, start=None, stop=None) -> DataFrame:
    li = t.lineitem.select(day_of("l_shipdate").alias("day"),
                           F.col("l_suppkey").alias("account_id"), "l_linestatus")
    if start is not None:
        li = li.where(_between(F.col("day"), start, stop))
    li = li.where((F.col("l_linestatus") == "F") & ((F.col("account_id") + F.year("day")) % 3 != 0))
    return li.select("account_id", "day").distinct()


def verified_accounts(t: Tables, start=None, stop=None) -> DataFrame:
    ev = t.events.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("account_id"), day_of("ts").alias("day"))
    if start is not None:
        ev = ev.where(_between(F.col("day"), start, stop))
    return ev.distinct()


def segment_monthly(t: Tables, start=None, stop=None) -> DataFrame:
    """Monthly segment per account; with ``start``/``stop`` only the whole months covering that
    range are derived (the bounds reach both scans)."""
    li = t.lineitem.select(F.col("l_suppkey").alias("us_id"), day_of("l_shipdate").alias("d"))
    ev = t.events.select(F.col("user_id").alias("us_id"), day_of("ts").alias("d"))
    if start is not None:
        first = start.replace(day=1)
        last = add_months(stop, 1) - dt.timedelta(days=1)
        li = li.where(_between(F.col("d"), first, last))
        ev = ev.where(_between(F.col("d"), first, last))
    both = li.unionByName(ev).select("us_id", month_number("d").alias("month_")).distinct()
    return both.withColumn("segment", (F.col("us_id") % 4 + 1).cast("int"))


def category_tree(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("ca_id_leaf"),
                         F.col("p_type").alias("new_meta"),
                         F.col("p_brand").alias("new_ca_name_1"))


def owner_map(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("ud_us_id"),
                             F.col("c_nationkey").cast("string").alias("nip"))


def test_users(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("us_id"))


def account_status_history(t: Tables) -> DataFrame:
    """Status history: every account has a current row ('N'); every third account also an older
    'company' row.  Both come from one scan (one or two rows generated per account)."""
    k = F.col("c_custkey")
    current = F.struct(
        F.when(k % 5 == 0, "company").when(k % 5 == 1, "ver").when(k % 5 == 4, F.lit(None))
         .otherwise("plain").alias("cis_status"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 500).cast("int")).alias("cis_from_date"),
        F.lit("N").alias("cis_historical"))
    older = F.when(k % 3 == 0, F.struct(
        F.lit("company").alias("cis_status"),
        F.date_add(F.lit("1998-01-01").cast("date"), (k % 500).cast("int")).alias("cis_from_date"),
        F.lit("T").alias("cis_historical")))
    rows = t.customer.select(k.alias("cis_user_id"),
                             F.explode(F.filter(F.array(current, older), lambda x: x.isNotNull())).alias("h"))
    return rows.select("cis_user_id", "h.cis_status", "h.cis_from_date", "h.cis_historical")


def last_logins(t: Tables, until=None) -> DataFrame:
    """Last event of each account; ``until`` is the snapshot's day (events of later days are unknown to it)."""
    ev = t.events if until is None else t.events.where(day_of("ts") <= F.lit(until))
    return ev.groupBy(F.col("user_id").alias("account_id")).agg(
        F.max("ts").alias("success_login_timestamp"))


def users(t: Tables, with_login: bool = False) -> DataFrame:
    """Account snapshot (one row per account; the supplied data has no daily history)."""
    k = F.col("c_custkey")
    df = t.customer.select(
        k.alias("account_id"),
        F.col("c_name").alias("login"),
        F.when(F.col("c_acctbal") < 0, "blocked").otherwise("active").alias("account_status"),
        F.when(F.col("c_mktsegment") == "BUILDING", "company").otherwise("private").alias("account_type"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 2000).cast("int")).alias("account_create_date"),
    )
    if with_login:
        df = df.join(last_logins(t), "account_id", "left")
    return df


def account_type_history(t: Tables) -> DataFrame:
    """Account types by day as intervals (both ends included, a null end is open).  The supplied accounts have one
    state each, so there is one open interval an account."""
    return users(t).select("account_id", "account_type", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def consents(t: Tables) -> DataFrame:
    ev = t.events.where(F.col("event_type").isin("signup", "click"))
    return ev.select(
        day_of("ts").alias("day"),
        F.col("user_id").alias("userid"),
        F.when(F.col("event_type") == "signup", CONSENT_MARKETING).otherwise(CONSENT_TESTING).alias("consentname"),
        F.when(F.col("event_id") % 2 == 0, "PHONE").otherwise("EMAIL").alias("channel"),
        (F.col("value") >= 50).alias("approved"),
    )


def net_gmv_daily(t: Tables, start=None, stop=None) -> DataFrame:
    li = t.lineitem.where(F.col("l_returnflag") != "R").select(
        day_of("l_shipdate").alias("dt"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_extendedprice").cast(MONEY).alias("GMV_ref"),
    )
    if start is not None:
        li = li.where(_between(F.col("dt"), start, stop))
    return li


def ratings(t: Tables) -> DataFrame:
    et = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("opponent_id"),
        F.when(et == "view", F.lit(None).cast("boolean")).when(et == "error", F.lit(False))
         .otherwise(F.lit(True)).alias("recommend"),
        F.col("ts").alias("create_date"),
    )


def fees(t: Tables, start=None, stop=None) -> DataFrame:
    ev = t.events.select(
        day_of("ts").alias("day"),
        F.col("user_id").alias("account_id"),
        F.col("event_type").alias("short_type"),
        (F.col("value").cast(MONEY) - F.lit(50)).cast(MONEY).alias("gross_amount"),
        F.when(F.col("event_id") % 10 == 0, "other").otherwise("main").alias("marketplace"),
    )
    if start is not None:
        ev = ev.where(_between(F.col("day"), start, stop))
    return ev


def fee_types(spark) -> DataFrame:
    """The fixed fee-type list as a JVM-side relation (no Python rows to ship)."""
    rows = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).cast("string").alias("my_group_desc"))
                     for k, v in FEE_GROUPS])
    return spark.range(1).select(F.inline(rows))


def owner_list(t: Tables) -> DataFrame:
    return t.nation.where(F.col("n_regionkey").isin(1, 3)).select(
        F.col("n_nationkey").cast("string").alias("nip"))


def account_list(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").alias("us_id"), F.col("c_mktsegment").alias("list_segment"),
        F.col("c_acctbal").alias("list_balance"))


def webinar_attendance(t: Tables) -> DataFrame:
    ev = t.events.where(F.col("event_type") == "signup")
    return ev.select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("account_name"),
        F.concat(F.lit("webinar-"), (F.col("event_id") % 4).cast("string")).alias("webinar_title"),
    )

