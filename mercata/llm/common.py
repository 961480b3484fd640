"""Helpers shared by the operators: checkpoints, text blocks for tasks, word hashes, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercata.session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step holds at once (a longer single text is a block of its own).
BLOCK_BYTES = 1 << 19
#: Odd multiplier of the polynomial word hash; its inverse modulo 2**64 exists.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``: cuts lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: like :func:`checkpoint`, but compressed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing reads any more, and the shuffle files of finished steps."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()  # Spark removes a shuffle's files once the driver has collected its plan


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, off = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + off)[off:] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES):
    """Yield (first row, row after the last, bytes, offsets) with at most ``size`` bytes a block,
    unless one text alone is longer."""
    data, offsets = text_arrays(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def small_batches(batches, rows: int = 512):
    """The same rows in batches of at most ``rows``, so that a task holds little at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of bytes marked ``inside``, never across texts: (start, end, text number)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside & (edge[:n] | ~np.concatenate(([False], inside[:-1])))
    end = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, "right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, grown on demand."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("q", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _POWERS[name] = a
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte * P**position; :func:`range_hash` reads any range from them."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of data[start:end]."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node named by an edge; component is the smallest node reached.

    Alternating large-star and small-star rounds of aggregations and joins; each round is
    checkpointed.  No neighbourhood is ever gathered in one task: minima are partial aggregates,
    and joins on a hub are split by the adaptive skew join.
    """
    E = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    E, seen = checkpoint(E), None
    while True:
        both = E.union(E.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        E = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = E.groupBy("v").agg(F.min("u").alias("m"))
        E = (E.join(low, "v").select(F.col("m").alias("m"), "u", "v")
             .select("m", F.explode(F.array("u", "v")).alias("x")).where("m < x").distinct()
             .select(F.col("m").alias("u"), F.col("x").alias("v")))
        E = checkpoint(E)
        now = E.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == seen:
            break
        seen = now
    return E.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        E.select("u", "u").distinct())
