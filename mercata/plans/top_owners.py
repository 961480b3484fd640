"""Top-owner report: monthly net GMV per owner cell, ratings, qualification, ranks, pivots.

Grain of the hub (``net_gmv_monthly``): owner (tax id) x month x meta category x level-1
category x order type (B2B when the buyer is a company account).

Scale notes
-----------
* Order lines are reduced to (seller, leaf, month, order type) before the owner map and the category
  tree are joined: both are one row per key, so summing first is exact and the dimension joins see
  the reduced cells instead of every line.
* The order day is the header's on both sides.  Gross and refund lines are two scans: the gross side is an
  inner join with the window's orders, the refund side reads the lines of its dates only.  They are
  netted per cell by presence flags (no self join); ``net_gmv_full_outer`` keeps the literal full outer join form.
* The flagship reads the hub five times (qualification, two rankings, one wide per-owner
  aggregate for the annual total and all pivots); equal exchanges are reused by the adaptive plan.
* The three rating measures of the flagship come from one scan of the ratings window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import month_key
from mercata.functions.numeric import report_round, round_half_up, safe_ratio
from mercata.operators import joins, reshape, windows
from mercata.operators.aggregates import count_periods_at_least
from mercata.params import COMPANY_ACCOUNT, ORDER_TYPES, TopOwnerParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

CELL = ["nip", "month", "new_meta", "new_ca_name_1", "order_type"]


def owners(t: Tables) -> DataFrame:
    """Account -> owner map restricted to accounts that have an owner."""
    return V.owner_map(t).where(F.col("nip").isNotNull())


def _with_order_type(lines: DataFrame, t: Tables, history: DataFrame | None) -> DataFrame:
    """lines (buyer_id, order_day, ...) plus ``order_type``, by the buyer's account type on the order day.  A line
    without an order of the window is B2C."""
    b2b, b2c = ORDER_TYPES
    states = V.account_type_history(t) if history is None else history
    lines = joins.valid_on(lines, states.withColumnRenamed("account_id", "buyer_id"), ["buyer_id"], "order_day")
    return lines.withColumn("order_type", F.when(F.col("account_type") == COMPANY_ACCOUNT, b2b).otherwise(b2c))


def _to_cells(cells: DataFrame, t: Tables, out: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(seller, month, leaf, order_type, out, *extra) sums -> owner cells (+ extra keys)."""
    cells = cells.join(owners(t), cells.seller_id == F.col("ud_us_id"))
    tree = V.category_tree(t)
    cells = cells.join(tree, cells.category_id == tree.ca_id_leaf, "left")
    return cells.groupBy(*CELL, *extra).agg(F.sum(out).alias(out))


def _window_orders(t: Tables, p: TopOwnerParams) -> DataFrame:
    """Headers of the orders whose order day lies in the window (the bound reaches the scan)."""
    return V.order_headers(t, p.date_start, p.date_stop).select(
        F.col("order_offer_id").alias("deal_id"), "buyer_id", F.col("day").alias("order_day"))


def gross_lines(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Sums of the window's orders by (seller, month of the order day, leaf, order type).

    Order day and ship day are unrelated, so the lines have no date bound; the inner join lets Spark test them
    against a runtime Bloom filter of the window's order keys before they are shuffled (``session.DEFAULTS``)."""
    s = _with_order_type(V.sales(t).join(_window_orders(t, p), "deal_id"), t, history)
    return s.groupBy("seller_id", month_key("order_day").alias("month"), "category_id", "order_type").agg(F.sum("price").alias("amount"))


def refund_lines(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Sums of the refunds recorded in the window (the bound reaches the scan of the lines) by (seller, refund month,
    leaf, order type).

    The order must lie in the window too (a right-side predicate of a left join): refunds of older
    orders stay, as B2C with the category unknown, so they are never netted against a cell.
    """
    r = V.refunds(t, p.date_start, p.date_stop)
    r = _with_order_type(r.join(_window_orders(t, p).withColumnRenamed("deal_id", "order_id"), "order_id", "left"), t, history)
    known = F.when(F.col("order_day").isNotNull(), F.col("category_id")).alias("category_id")
    return r.groupBy("seller_id", month_key("day").alias("month"), known, "order_type").agg(F.sum("refunded_gmv").alias("amount"))


def gross_by_cell(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Sum of order prices per owner cell (month of the order day)."""
    return _to_cells(gross_lines(t, p, history).withColumnRenamed("amount", "gmv"), t, "gmv")


def refund_by_cell(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Refunded amount per owner cell, by refund month; category and buyer type of the refunded order."""
    return _to_cells(refund_lines(t, p, history).withColumnRenamed("amount", "ref_gmv"), t, "ref_gmv")


def _side_cells(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Order ('o') and refund ('r') cells: both branches are summed per leaf before they meet the dimensions."""
    sides = gross_lines(t, p, history).withColumn("side", F.lit("o")).unionByName(
        refund_lines(t, p, history).withColumn("side", F.lit("r")))
    return _to_cells(sides, t, "amount", ("side",))


def net_gmv_monthly(t: Tables, p: TopOwnerParams, history: DataFrame | None = None) -> DataFrame:
    """Gross minus refunds per cell, with the report's full-outer-join semantics.

    Owner and month come from the order side only, so refund-only cells end in one NULL
    owner/month row per (type, category, level-1) with a NULL amount, and a NULL category never
    matches a NULL category.  Both sides (``_side_cells``) are combined per cell by presence flags
    instead of a self join.  ``history`` gives the buyers' account types by day (``views.account_type_history``):

    * order side present: the cell, amount = gmv - refunds if all keys are known else gmv;
    * refund side present without a matching order side (absent, or a NULL key): a refund-only row.
    """
    return net_cells(_side_cells(t, p, history))


def net_cells(cells: DataFrame) -> DataFrame:
    """Net (CELL..., side, amount) rows, side 'o' (orders) or 'r' (refunds), with the report's
    full-outer-join rules (see ``net_gmv_monthly``)."""
    c = cells.groupBy(*CELL).agg(
        F.sum(F.when(F.col("side") == "o", F.col("amount"))).alias("gmv"),
        F.sum(F.when(F.col("side") == "r", F.col("amount"))).alias("ref_gmv"),
        F.max(F.col("side") == "o").alias("has_o"),
        F.max(F.col("side") == "r").alias("has_r"))
    complete = F.col("new_meta").isNotNull() & F.col("new_ca_name_1").isNotNull()
    order_row = F.when(F.col("has_o"), F.struct(
        F.col("nip").alias("n"), F.col("month").alias("m"),
        F.when(complete, F.col("gmv") - F.coalesce(F.col("ref_gmv"), F.lit(0))).otherwise(F.col("gmv")).alias("v")))
    refund_only = F.when(F.col("has_r") & (~F.col("has_o") | ~complete), F.struct(
        F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("m"),
        F.lit(None).cast("decimal(38,2)").alias("v")))
    rows = c.select("order_type", "new_meta", "new_ca_name_1",
                    F.explode(F.filter(F.array(order_row, refund_only), lambda x: x.isNotNull())).alias("r"))
    return rows.groupBy(F.col("r.n").alias("nip"), F.col("r.m").alias("month"), "order_type", "new_meta",
                        "new_ca_name_1").agg(F.sum("r.v").alias("gmv"))


def net_gmv_full_outer(gross: DataFrame, refunds: DataFrame) -> DataFrame:
    """The report's literal form: order cells FULL OUTER JOIN refund cells on the five keys."""
    o = gross.alias("o")
    r = refunds.alias("r")
    cond = [F.col(f"o.{k}") == F.col(f"r.{k}") for k in CELL]
    j = o.join(r, cond, "full_outer").select(
        F.col("o.nip").alias("nip"),
        F.col("o.month").alias("month"),
        F.coalesce("o.order_type", "r.order_type").alias("order_type"),
        F.coalesce("o.new_meta", "r.new_meta").alias("new_meta"),
        F.coalesce("o.new_ca_name_1", "r.new_ca_name_1").alias("new_ca_name_1"),
        F.col("o.gmv").alias("gmv_o"),
        F.col("r.ref_gmv").alias("ref_gmv"),
    )
    return j.groupBy("nip", "month", "order_type", "new_meta", "new_ca_name_1").agg(
        (F.sum("gmv_o") - F.sum(F.coalesce("ref_gmv", F.lit(0)))).alias("gmv"))


def net_gmv_annual(gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Net GMV per owner from the start up to, excluding, the running month."""
    return closed_months(gmv_monthly, p).groupBy("nip").agg(F.sum("gmv").alias("gmv"))


def gmv_pivot_recent(spark, gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Last three full months, B2B / B2C columns (suffix ``_3m``)."""
    spine = reshape.month_spine(spark, p.start_of_3_month_period, p.last_day_of_month)
    g = gmv_monthly.join(spine, "month").groupBy("nip", "order_type") \
        .agg(round_half_up(F.sum("gmv"), 2).alias("gmv"))
    return reshape.named_pivot(g, ["nip"], "order_type", ORDER_TYPES, F.sum("gmv"), "gmv_", "_3m")


def gmv_pivot_months(gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    g = gmv_monthly.groupBy("nip", "month").agg(round_half_up(F.sum("gmv"), 2).alias("gmv"))
    return reshape.named_pivot(g, ["nip"], "month", p.pivot_months, F.sum("gmv"), "gmv_")


def gmv_pivot_type(gmv_monthly: DataFrame) -> DataFrame:
    """Whole period including the running month, B2B / B2C columns."""
    g = gmv_monthly.groupBy("nip", "order_type").agg(round_half_up(F.sum("gmv"), 2).alias("gmv"))
    return reshape.named_pivot(g, ["nip"], "order_type", ORDER_TYPES, F.sum("gmv"), "gmv_")


def owner_wide(gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Per owner in one aggregation: annual GMV (running month excluded) and the three pivots
    (every month, B2B / B2C over the whole period, B2B / B2C over the last three full months).

    With the value lists known, a pivot cell is a conditional sum, so the three pivots and the
    annual total share one shuffle of the hub; results equal ``gmv_pivot_*`` / ``net_gmv_annual``.
    """
    m, t = F.col("month"), F.col("order_type")

    def cell(cond):
        return round_half_up(F.sum(F.when(cond, F.col("gmv"))), 2)

    recent = m.isin(p.recent_months)
    return gmv_monthly.groupBy("nip").agg(
        round_half_up(F.sum(F.when(m != p.running_month, F.col("gmv"))), 2).alias("gmv12m"),
        *[cell(m == k).alias(f"gmv_{k}") for k in p.pivot_months],
        *[cell(t == k).alias(f"gmv_{k}") for k in ORDER_TYPES],
        *[cell((t == k) & recent).alias(f"gmv_{k}_3m") for k in ORDER_TYPES])


def _account_opinions(t: Tables, start, stop, recent_start=None) -> DataFrame:
    """Ratings of the window counted per rated account (positive / with an opinion, optionally also
    for the recent part), then mapped to owners: the owner join sees one row per account instead of
    every rating."""
    r = V.ratings(t).where(F.to_date("create_date").between(F.lit(start), F.lit(stop)))
    pos = F.col("recommend").eqNullSafe(True)
    opinion = F.col("recommend").isNotNull()
    counts = [F.count_if(pos).alias("positive"), F.count_if(opinion).alias("rated")]
    if recent_start is not None:
        recent = F.to_date("create_date") >= F.lit(recent_start)
        counts += [F.count_if(pos & recent).alias("positive_3m"), F.count_if(opinion & recent).alias("rated_3m")]
    per_account = r.groupBy(F.col("opponent_id").alias("account_id")).agg(*counts)
    return per_account.join(owners(t), F.col("account_id") == F.col("ud_us_id"))


def _verified_days(t: Tables, p: TopOwnerParams) -> DataFrame:
    return V.verified_accounts(t, p.rating_start, p.rating_stop).groupBy("account_id") \
        .agg(F.count(F.lit(1)).alias("w"))


def rating_quality(t: Tables, p: TopOwnerParams, recent: bool = False) -> DataFrame:
    """Positive share of ratings per owner (NULL opinions count in neither part)."""
    start = p.rating_recent_start if recent else p.rating_start
    a = _account_opinions(t, start, p.rating_stop)
    return a.groupBy("nip").agg(
        F.sum("positive").alias("positive"),
        F.sum("rated").alias("rated"),
        safe_ratio(F.sum("positive"), F.sum("rated")).alias("share"),
    )


def rating_qualified(t: Tables, p: TopOwnerParams) -> DataFrame:
    """Owners whose positive share reaches the limit, each rating weighted by the number of
    verified days of the rated account in the window (the report joined ratings to every
    verified day).  Weights and opinions are counted per account first, so no rating x day rows
    exist."""
    a = _account_opinions(t, p.rating_start, p.rating_stop).join(_verified_days(t, p), "account_id")
    g = a.groupBy("nip").agg(safe_ratio(F.sum(F.col("positive") * F.col("w")),
                                        F.sum(F.col("rated") * F.col("w"))).alias("share"))
    return g.where(F.col("share") >= p.min_rating_share)


def owner_ratings(t: Tables, p: TopOwnerParams) -> DataFrame:
    """Per owner from one scan of the ratings window: positive share over the whole window
    (``share``), over the recent window (``share_3m``) and weighted by verified days
    (``weighted_share``; NULL for owners whose rated accounts had no verified day).  Each share
    is NULL when there is no opinion to divide by."""
    a = _account_opinions(t, p.rating_start, p.rating_stop, p.rating_recent_start) \
        .join(_verified_days(t, p), "account_id", "left") \
        .withColumn("w", F.coalesce("w", F.lit(0)))
    return a.groupBy("nip").agg(
        safe_ratio(F.sum("positive"), F.sum("rated")).alias("share"),
        safe_ratio(F.sum("positive_3m"), F.sum("rated_3m")).alias("share_3m"),
        safe_ratio(F.sum(F.col("positive") * F.col("w")), F.sum(F.col("rated") * F.col("w"))).alias("weighted_share"))


def gmv_qualified(gmv_monthly: DataFrame, rated_owners: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Qualified owners with monthly net GMV >= limit in at least ``min_months`` months."""
    per_month = gmv_monthly.groupBy("nip", "month").agg(F.sum("gmv").alias("gmv"))
    j = joins.restrict(per_month, rated_owners, "nip")
    return j.groupBy("nip").agg(count_periods_at_least(F.col("gmv"), p.monthly_gmv_limit).alias("months_over")) \
        .where(F.col("months_over") >= p.min_months)


def category_ranks(gmv_monthly: DataFrame, p: TopOwnerParams, with_sub: bool = False) -> DataFrame:
    """RANK of categories per owner by net GMV (ties broken by the meta name only), running month excluded."""
    keys = ["nip", "new_meta"] + (["new_ca_name_1"] if with_sub else [])
    g = closed_months(gmv_monthly, p).groupBy(*keys).agg(F.sum("gmv").alias("gmv_main"))
    return windows.ranked(g, ["nip"], [F.desc("gmv_main"), F.asc("new_meta")], "ranking")


def closed_months(gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Hub rows of finished months (the running month excluded; NULL months drop too)."""
    return gmv_monthly.where(F.col("month") != p.running_month)


def top_categories(gmv_monthly: DataFrame, p: TopOwnerParams) -> DataFrame:
    """Best meta category, best (meta, level-1) and second meta per owner."""
    m = category_ranks(gmv_monthly, p)
    m1 = category_ranks(gmv_monthly, p, with_sub=True)
    best = m.where("ranking = 1").select("nip", "new_meta", round_half_up("gmv_main", 2).alias("gmv"))
    best1 = m1.where("ranking = 1").select("nip", "new_ca_name_1", round_half_up("gmv_main", 2).alias("gmv1"))
    second = m.where("ranking = 2").select("nip", F.col("new_meta").alias("second_new_meta"),
                                           round_half_up("gmv_main", 2).alias("second_new_meta_gmv"))
    return best.join(best1, "nip").join(second, "nip", "left")


def top_owner_report(t: Tables, p: TopOwnerParams) -> DataFrame:
    """Flagship: qualified owners with ratings, annual GMV, ranks and three pivots."""
    hub = net_gmv_monthly(t, p)
    ratings = owner_ratings(t, p)
    rated = ratings.where(F.col("weighted_share") >= p.min_rating_share)
    chosen = gmv_qualified(hub, rated, p).select("nip")
    q = ratings.select("nip", report_round("share").alias("rating_share"),
                       report_round("share_3m").alias("rating_share_3m"))
    out = (chosen.join(q, "nip")
           .join(top_categories(hub, p), "nip")
           .join(owner_wide(hub, p), "nip", "left"))
    first = ["nip", "rating_share", "rating_share_3m", "gmv12m", "new_meta", "gmv", "new_ca_name_1", "gmv1",
             "second_new_meta", "second_new_meta_gmv"]
    return out.select(*first, *[c for c in out.columns if c not in first])
