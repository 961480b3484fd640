"""Yearly verification status change of sellers and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.cases import case_ladder, flag
from mercata.functions.dates import year_of
from mercata.operators import joins, windows
from mercata.params import StatusParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

# Change labels (verified_status +1 / 0 / -1) and yes / no labels.
CHANGE_LABELS = {1: "regular -> company", 0: "no change", -1: "company -> regular"}
YES, NO = "yes", "no"


def yearly_status_change(t: Tables, p: StatusParams) -> DataFrame:
    """(seller, year): verified in the year (0/1), change against the previous present year,
    offers and non-classified offers; test accounts excluded before the LAG."""
    o = V.offers_total(t, p.date_from, p.date_to)
    per_year = o.groupBy("seller_id", year_of("day").alias("year")).agg(
        F.sum("offers").alias("sum_of_offers"),
        F.sum("offers_no_classifieds").alias("sum_of_offers_no_clasifieds"))
    ver = V.verified_sellers(t, p.date_from, p.date_to) \
        .select(F.col("account_id").alias("seller_id"), year_of("day").alias("year"))
    j = joins.existence_flag(per_year, ver, ["seller_id", "year"], name="verified")
    j = joins.exclude(j, V.test_users(t), "seller_id", "us_id")
    j = windows.lag_delta(j, ["seller_id"], "year", "verified", "verified_status")
    return j.select("seller_id", "year", "verified", "verified_status", "sum_of_offers",
                    "sum_of_offers_no_clasifieds")


def _prepare(yearly: DataFrame) -> DataFrame:
    d = yearly.fillna(0, subset=["verified_status", "sum_of_offers", "sum_of_offers_no_clasifieds"])
    return d.withColumn("only_clasifieds",
                        flag((F.col("sum_of_offers") > 0) & (F.col("sum_of_offers_no_clasifieds") == 0)))


def status_change_summary(yearly: DataFrame) -> DataFrame:
    """(year, change, classified-only): offer sums, number of sellers and two text labels.
    The first year of a seller has no previous year and counts as 'no change'."""
    g = _prepare(yearly).groupBy("year", "verified_status", "only_clasifieds").agg(
        F.sum("sum_of_offers").alias("sum_of_offers"),
        F.sum("sum_of_offers_no_clasifieds").alias("sum_of_offers_no_clasifieds"),
        F.count("seller_id").alias("count_seller_id"))
    vs = F.col("verified_status")
    return g.withColumn("verified_status_desc", case_ladder(
        [(vs == 1, CHANGE_LABELS[1]), (vs == 0, CHANGE_LABELS[0])], CHANGE_LABELS[-1])) \
        .withColumn("only_clasifieds_desc", flag(F.col("only_clasifieds") == 1, YES, NO))


def status_change_share(summary: DataFrame) -> DataFrame:
    """Share of sellers per change label within each year."""
    g = summary.groupBy("year", "verified_status", "verified_status_desc") \
        .agg(F.sum("count_seller_id").alias("count_seller_id"))
    return windows.share_of_group(g, ["year"], "count_seller_id", "share")


def head_sample(yearly: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` (seller, year) rows in key order: the sample the analyst checked by eye."""
    return yearly.orderBy("seller_id", "year").limit(n)


def only_classified_sellers(yearly: DataFrame, year: int) -> DataFrame:
    """Sellers whose offers in ``year`` were all classified, first row per seller."""
    d = _prepare(yearly).where((F.col("only_clasifieds") == 1) & (F.col("year") == year))
    return windows.first_per_key(d, ["seller_id"], [F.col("year")])
