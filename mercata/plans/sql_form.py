"""The analyst scripts were parameterised SQL (DECLARE ... DEFAULT).  The same form in Spark:
``spark.sql`` with named parameter markers and DataFrames bound as relations, so the text goes
through the same Catalyst plan as the DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mercata.params import AccountParams
from mercata.sources import views as V
from mercata.sources.tables import Tables

OWNER_OFFERS_SQL = """
SELECT nip.nip, SUM(o.offers) AS offers
FROM {offers} o
JOIN {owner_map} nip ON nip.ud_us_id = o.seller_id
JOIN {owner_list} listed ON listed.nip = nip.nip
WHERE o.day = :as_of
GROUP BY nip.nip
"""


def owner_active_offers_sql(t: Tables, p: AccountParams) -> DataFrame:
    """Active offers yesterday per listed owner, written as parameterised Spark SQL."""
    return t.spark.sql(OWNER_OFFERS_SQL, args={"as_of": p.sales_yesterday},
                       offers=V.offers_total(t), owner_map=V.owner_map(t), owner_list=V.owner_list(t))
