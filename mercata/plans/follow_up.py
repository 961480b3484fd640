"""Follow-ups for a list of owners: fee summary and the dense owner x month forecast panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import month_key
from mercata.functions.numeric import report_round
from mercata.operators import joins, reshape, scans
from mercata.params import FollowUpParams
from mercata.sources import views as V
from mercata.sources.tables import Tables


def _owner_accounts(t: Tables, owner_list: DataFrame) -> DataFrame:
    """Listed owners with their accounts (an owner without accounts keeps a NULL id)."""
    m = V.owner_map(t).where(F.col("nip").isNotNull()).select("nip", F.col("ud_us_id").alias("id"))
    return owner_list.join(m, "nip", "left")


def fee_summary(t: Tables, p: FollowUpParams, owner_list: DataFrame | None = None) -> DataFrame:
    """(month, owner, fee type, fee group): gross amount; zero totals dropped.
    Fee types without a group and other marketplaces are excluded."""
    lst = owner_list if owner_list is not None else V.owner_list(t)
    types = V.fee_types(t.spark).where(F.col("my_group_desc").isNotNull())
    f = V.fees(t, p.fee_start, p.fee_stop).where(F.col("marketplace") == p.marketplace)
    f = f.join(types, f.short_type == types.id).groupBy(
        F.col("account_id").alias("id"), "short_type", "my_group_desc", month_key("day").alias("month")) \
        .agg(F.sum("gross_amount").alias("amount"))
    j = f.join(_owner_accounts(t, lst), "id")
    g = j.groupBy("month", "nip", "short_type", "my_group_desc").agg(F.sum("amount").alias("amount"))
    return g.where(F.abs("amount") > 0)


def forecast_panel(t: Tables, p: FollowUpParams, owner_list: DataFrame | None = None,
                   join_gmv_on_spine: bool = False) -> DataFrame:
    """Owner x month from start to stop: mean daily offers and net GMV, gaps as 0.  Amounts are
    summed per account before the owner join.

    Both measures of an owner become maps from month to value in one aggregation, and the months are read from
    them along a sequence, so there is no grid to join.

    As in the report, GMV is attached through the offers row of the month, so a month without
    offers shows GMV 0; ``join_gmv_on_spine`` attaches it to the grid instead.
    """
    lst = owner_list if owner_list is not None else V.owner_list(t)
    acc = _owner_accounts(t, lst.distinct())
    o = V.offers_total(t, p.forecast_start, p.forecast_stop)
    daily = o.join(acc, o.seller_id == acc.id).groupBy("day", "nip").agg(F.sum("offers").alias("offers"))
    offers = daily.groupBy(month_key("day").alias("month"), "nip") \
        .agg(report_round(F.avg("offers"), 2).alias("offers"))
    g = scans.date_range(V.net_gmv_daily(t), "dt", p.forecast_start, p.forecast_stop) \
        .groupBy("account_id", month_key("dt").alias("month")).agg(F.sum("GMV_ref").alias("gmv"))
    gmv = g.join(acc, g.account_id == acc.id).groupBy("month", "nip").agg(F.sum("gmv").alias("gmv"))
    filled = reshape.fill_months(lst, {"offers": offers, "gmv": gmv}, ["nip"], p.forecast_start, p.forecast_stop)
    shown = F.lit(True) if join_gmv_on_spine else F.col("offers").isNotNull()
    return filled.select("nip", "month", F.coalesce("offers", F.lit(0.0)).alias("offers"),
                         F.coalesce(F.when(shown, F.col("gmv")), F.lit(0)).alias("gmv"))
