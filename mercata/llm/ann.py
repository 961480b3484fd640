"""Approximate nearest neighbours: forest of random-projection trees, one shared priority queue,
exact reranking.

The forest is fitted on a bounded sample (``SAMPLE_ROWS`` vectors, smallest hashes of the id): every tree
halves the sample ``DEPTH`` times at the median of a random direction (the difference of two sample
vectors of the node).  Every row of the table is then put into one leaf of each tree.

A query walks all trees through one priority queue.  A node's priority is the sum of the squared margins
by which its path leaves the query's own side, a lower bound of the way to that cell, and the
``PROBES`` filled leaves that come out first, of whichever trees, are its candidates (with the empty ones on
the way; filled: by the sample).  The number of leaves does
not depend on the input, so a fixed number of probes reads a fixed share of the rows.

Rows and queries meet per chunk of a leaf (sorted; a chunk's rows are held, its queries streamed). A leaf has as many
chunks as keep them at ``CHUNK_ROWS`` rows on average, each gets all queries of the leaf, so no task holds a
share of the input.  The price of a probe stays that share: at 288 probes of 1/256 of the rows a query meets each
row 1.1 times on average over the trees, some rows often and a third of them never.  Tasks keep the best ``k`` of each query so far and the final top-k compares exact double-precision inner products of the
original vectors.  Equal vectors are one candidate that carries its k + 1 smallest ids: ties go to the
smaller id, so no further copy can be in an answer.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; a repeated (id, vector) row counts once; rows of one id with different
vectors are different candidates (such an id may stand more than once in an answer) and one query, whose answer is the
best k pairs of any of its vectors with any candidate; a row with the query's own id is never its neighbour; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint

SAMPLE_ROWS, TREES, DEPTH, PROBES = 16_384, 16, 8, 288
#: Rows of a leaf compared with queries at once, and candidates a task holds before it prunes.
BLOCK, HELD = 2048, 1 << 20
#: Rows of a leaf that a group holds on average; larger leaves are split into chunks that each get the leaf's queries.
CHUNK_ROWS = 16_384


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): distinct rows whose vector takes part, v an array of doubles (-0.0 as 0.0)."""
    v = F.col("v")
    src = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = src.where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)
                     & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                     & F.exists(v, lambda x: x != 0))
    return good.select("id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per tree: directions and thresholds of the inner nodes, level by level, and which leaves the sample fills."""
    forest, rng = [], np.random.default_rng(seed)
    for _ in range(trees):
        w = np.zeros((2 ** depth - 1, sample.shape[1]), np.float32)
        b = np.zeros(2 ** depth - 1, np.float32)
        leaf = np.zeros(len(sample), np.int64)
        for level in range(depth):
            order = np.argsort(leaf, kind="stable")
            cut = np.searchsorted(leaf[order], np.arange(2 ** level + 1))
            for k in range(2 ** level):
                rows, node = order[cut[k]:cut[k + 1]], 2 ** level - 1 + k
                d = rng.normal(size=sample.shape[1])
                if len(rows) > 1:
                    x, y = rng.choice(rows, 2, replace=False)
                    apart = sample[x] - sample[y]
                    d = apart if np.any(apart) else d
                w[node] = d / np.linalg.norm(d)
                side = sample[rows] @ w[node]
                b[node] = np.median(side) if len(rows) else 0
                leaf[rows] = 2 * k + (side > b[node])
        forest.append((w, b, np.isin(np.arange(2 ** depth), leaf)))
    return forest


def leaf_of(x: np.ndarray, w: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    leaf = np.zeros(len(x), np.int64)
    for level in range(depth):
        node = 2 ** level - 1 + leaf
        leaf = 2 * leaf + (np.einsum("ij,ij->i", x, w[node]) > b[node])
    return leaf


def probe(q: np.ndarray, forest, depth: int, probes: int) -> list[int]:
    """Leaf numbers (tree * 2**depth + leaf) in the order in which the shared queue yields them, until
    ``probes`` of them are leaves that the sample fills."""
    margins = [(w @ q - b).tolist() for w, b, _ in forest]
    queue, found, full = [(0.0, t, 0, 0) for t in range(len(forest))], [], 0
    while queue and full < probes:
        far, t, level, k = heapq.heappop(queue)
        while level < depth:
            m = margins[t][2 ** level - 1 + k]
            near = 2 * k + (m > 0)
            heapq.heappush(queue, (far + m * m, t, level + 1, near ^ 1))
            level, k = level + 1, near
        found.append((t << depth) + k)
        full += int(forest[t][2][k])
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _place(forest, depth: int, probes: int, chunks: int, queries: bool):
    """Rows -> (leaf, query, number, vector): one row per tree, or per chunk of a probed leaf for queries;
    leaf is leaf number * chunks + chunk."""
    def run(batches):
        for b in batches:
            v, no = _matrix(b.column("v")), b.column("no").to_numpy(zero_copy_only=False)
            for i in range(0, len(v), 512):
                part = v[i:i + 512].astype(np.float32)
                if queries:
                    at = [probe(q, forest, depth, probes) for q in part]
                    leaf = np.concatenate([np.array(x) for x in at])
                    row = np.repeat(np.arange(len(part)), [len(x) * chunks for x in at])
                    leaf = (leaf[:, None] * chunks + np.arange(chunks)).ravel()
                else:
                    leaf = np.concatenate([(t << depth) + leaf_of(part, w, c, depth) for t, (w, c, _) in enumerate(forest)])
                    row = np.tile(np.arange(len(part)), len(forest))
                    # numbers follow partitions and the order of ids: multiplied by an odd constant, the top bits deal them out
                    mixed = (no[i:i + 512].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    leaf = leaf * chunks + (mixed % np.uint64(chunks)).astype(np.int64)[row]
                packed = [x.tobytes() for x in v[i:i + 512]]
                for s in range(0, len(leaf), 8192):
                    r = row[s:s + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[s:s + 8192]), pa.array(np.full(len(r), queries)), pa.array(no[i:i + 512][r]),
                         pa.array([packed[x] for x in r], pa.binary())], names=["leaf", "query", "no", "v"])
    return run


def _best(held, k):
    """The k best of each query among held (query, number, score) arrays; a candidate counts once."""
    q, c, s = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((c, q))
    q, c, s = q[order], c[order], s[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, s = q[first], c[first], s[first]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return q[rank < k], c[rank < k], s[rank < k]


def _search(k: int):
    """Sorted (leaf, query, no, v) rows, members of a leaf before its queries -> best k of each query."""
    def meet(members, queries):
        """members, queries: lists of (numbers, matrix) of one leaf."""
        for qn, qv in queries:
            for mn, mv in members:
                for i in range(0, len(mn), BLOCK):
                    s = qv @ mv[i:i + BLOCK].T
                    keep = min(k, s.shape[1])
                    kth = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                    # all that may tie with the kth go on: the tie rule needs exact scores and numbers
                    slack = 1e-12 * np.linalg.norm(qv, axis=1) * np.linalg.norm(mv[i:i + BLOCK], axis=1).max()
                    row, col = np.nonzero(s >= (kth - slack)[:, None])
                    # an exact sum in a fixed order, so that equal pairs score alike in every leaf
                    for j in range(0, len(row), 4096):
                        r, c = row[j:j + 4096], i + col[j:j + 4096]
                        yield qn[r], mn[c], (mv[c] * qv[r]).sum(axis=1)

    def run(batches):
        held, size, at, members, queries = [], 0, None, [], []
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            query = b.column("query").to_numpy(zero_copy_only=False)
            no = b.column("no").to_numpy(zero_copy_only=False)
            raw = b.column("v")
            v = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(no), -1)
            cut = np.flatnonzero((leaf[1:] != leaf[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(no)]):
                if leaf[lo] != at:
                    members, at = [], leaf[lo]
                if not query[lo]:
                    members.append((no[lo:hi], v[lo:hi].copy()))
                    continue
                for i in range(lo, hi, 256):
                    for part in meet(members, [(no[i:min(hi, i + 256)], v[i:min(hi, i + 256)])]):
                        held.append(part)
                        size += len(part[0])
                        if size > HELD:
                            held = [_best(held, k)]
                            size = len(held[0][0])
                            if size > HELD // 2:  # too many queries to hold: hand on what was found
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["q", "c", "score"])
                                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(held, k)], names=["q", "c", "score"])
    return run


def nearest(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, depth: int = DEPTH, probes: int = PROBES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k nearest found of each row that satisfies ``is_query``
    (a condition on ``id``), by inner product, nearest first, ties to the smaller id."""
    spark = table.sparkSession
    ids = usable(table, id_col, vector_col)
    by_vector = Window.partitionBy("v").orderBy("id")
    classes = (ids.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # numbered in the order of the smallest id, so that pruning by number keeps the tie rule
    classes = checkpoint(classes.orderBy(F.col("ids")[0], "v").withColumn("no", F.monotonically_increasing_id()))
    width = classes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    classes = classes.where(F.size("v") == width["w"])
    sample = classes.orderBy(F.xxhash64("no"), "no").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    forest = fit_forest(_matrix(sample).astype(np.float32), trees, depth)

    asked = ids.where(is_query).join(classes.select("v", "no"), "v").select(F.col("id").alias("query_id"), F.col("no").alias("q"))
    asked = checkpoint(asked)
    seekers = classes.select("v", "no").join(asked.select(F.col("q").alias("no")).distinct(), "no", "left_semi")
    place = "leaf long, query boolean, no long, v binary"
    chunks = -(-width["n"] // (chunk_rows << depth))
    met = classes.select("v", "no").mapInArrow(_place(forest, depth, probes, chunks, False), place).union(
        seekers.mapInArrow(_place(forest, depth, probes, chunks, True), place))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "leaf").sortWithinPartitions("leaf", "query")
    best = met.mapInArrow(_search(k + 1), "q long, c long, score double").distinct()
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = best.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    found = (best.join(classes.select(F.col("no").alias("c"), "ids"), "c")
             .select("q", "score", F.explode("ids").alias(id_col)).join(asked, "q").where(F.col(id_col) != F.col("query_id")))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return (found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_col, "score"))
