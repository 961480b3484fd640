"""Order and refund ledger of one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.dates import day_of
from mercata.params import LedgerParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

LEDGER_COLUMNS = ["ud_nip", "order_id", "offer_id", "refund_quantity", "refunded_gmv", "order_date",
                  "refund_date"]


def order_refund_ledger(t: Tables, p: LedgerParams) -> DataFrame:
    """Refunds (selected by refund day) and orders of the owner's accounts in one tagged list.

    Lines are cut to the owner's accounts first, then joined to their order headers once; a returned
    line gives a refund row beside its order row.  Orders have no refund date (typed NULL).
    """
    accounts = V.owner_map(t).where(F.col("nip") == p.owner).select("ud_us_id", F.col("nip").alias("ud_nip"))
    s = V.sales(t, p.date_from, p.date_to)
    s = s.join(accounts, s.seller_id == accounts.ud_us_id)
    hdr = t.orders.select(F.col("o_orderkey").alias("deal_id"), day_of("o_orderdate").alias("order_date"))
    kinds = F.array(F.struct(F.lit("order").alias("typ"), F.lit(None).cast("date").alias("refund_date")),
                    F.when(F.col("returned"), F.struct(F.lit("refund").alias("typ"), day_of("shipped_at").alias("refund_date"))))
    rows = s.join(hdr, "deal_id").withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return rows.select("kind.typ", "ud_nip", F.col("deal_id").alias("order_id"), "offer_id", F.col("quantity").alias("refund_quantity"),
                       F.col("price").alias("refunded_gmv"), "order_date", "kind.refund_date")
