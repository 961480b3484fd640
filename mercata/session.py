"""SparkSession construction with the settings the plans rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the plans assume; each is applied only when the deployment left it unset.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",                 # DATE(ts) / month keys never depend on the host
    "spark.sql.adaptive.enabled": "true",                # runtime re-planning (join strategy, coalescing)
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",       # split hot keys of inner / left joins
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # a large fact is tested against a Bloom filter of the selected keys of the other side before its shuffle; the
    # filter is bounded by Spark's maxNumBits, so the side it is made from may be larger than the 10 MB default
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "mercata") -> SparkSession:
    """Return (or create) a session configured for the plans.

    On a cluster, master, executor sizing, ``spark.sql.shuffle.partitions`` (or AQE's
    ``initialPartitionNum``) and ``spark.checkpoint.dir`` come from spark-submit; only unset
    settings are filled in.  An explicitly local session also gets the UI switched off and its
    checkpoint files cleaned when no longer referenced (on a cluster, set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` beside the folder).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = (builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
                   .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    explicit = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not explicit.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a bare local session gets a scratch one.

    Called where a checkpoint is taken; jobs without one need no folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server owns the checkpoint folder
        return configured or ""
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="mercata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path
