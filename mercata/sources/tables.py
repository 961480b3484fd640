"""Raw table access: one parquet dataset per logical table, read lazily.

Only ``spark.read.parquet`` is used; column pruning and predicate pushdown come from Catalyst
when the callers select / filter, so nothing here selects columns eagerly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Declared schemas of the supplied tables: reading with a schema skips footer inference jobs and
# fails loudly if a file drifts from the contract.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
TABLE_NAMES = tuple(SCHEMAS)


class Tables:
    """Locates the supplied tables under one directory (``{root}/{name}.parquet``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def read(self, name: str) -> DataFrame:
        """The table as a DataFrame; one relation per table and instance (footers are read once)."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
