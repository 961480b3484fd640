import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from mercata.session import ensure_checkpoint_dir  # noqa: E402
from mercata.sources.tables import SCHEMAS, Tables  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def make_tables(spark, tmp_path):
    """Write small fixture tables (lists of tuples in SCHEMAS order) and return a Tables over them.
    Tables not given are written empty."""

    def build(**rows):
        root = tmp_path / "tables"
        for name, ddl in SCHEMAS.items():
            df = spark.createDataFrame(rows.get(name, []), ddl)
            df.write.mode("overwrite").parquet(str(root / f"{name}.parquet"))
        return Tables(spark, str(root))

    return build
