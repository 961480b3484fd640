"""Exact top-k search by inner product over a vector-approximation file.

Components are the integers floor(256 x).  Every distinct vector gets an approximation, one byte a component: its cell
among at most ``CELLS`` ranges of that component.  The ranges hold about as many rows each (their borders are quantiles of at
most ``SAMPLE_ROWS`` vectors); the outermost two reach from the sample's ends to the ends of all rows.

1. Scan: queries meet the approximations of all rows, blocks of both at a time.  A cell bounds its component, so with
   m the middles and h the half widths of a row's cells the score lies within m.q -/+ h.|q|.  A candidate whose upper bound is
   below the (k + 1)-th best lower bound of its query can't be an answer; all others go on, none is cut off by a count.
2. Refinement: per query the candidates are read exactly in the order of their bounds, ``FIRST`` of them, then more in each
   round, until the (k + 1)-th exact score is above the bound of all that are left.

Rows and queries meet in groups of (query chunk, row slice): approximations are replicated once per ``CHUNK`` queries, and
no vector is broadcast.  Equal vectors are one candidate that carries its k + 1 smallest ids, so a hot vector costs no more
than any other; k + 1 classes hold k neighbours beside the query itself.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors
of another length than most (ties: the shorter; empty ones are never most) take no part; of several vectors under
one id the smallest, component by component, counts, and repeated rows count once; integers beyond the range of long
are cut to it, and so are scores; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint

SAMPLE_ROWS, CELLS, CHUNK, FIRST = 16_384, 64, 4096, 4
#: Rows of a block, queries compared at a time, candidates a task holds before it prunes or hands on.
BLOCK, STEP, HELD = 4096, 256, 1 << 19
EMPTY = "query_id long, rank int, {} long, score long"


def whole_numbers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, v an array of the integers floor(256 x); one row an id."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                      & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")  # ids alone are shuffled
    one = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return rows.join(several, "id", "left_anti").unionByName(one)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(no, ids, v packed): distinct vectors with their k + 1 smallest ids; no is the smallest.  Checkpointed."""
    by_vector = Window.partitionBy("v").orderBy("id")
    found = rows.withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))

    def pack(batches):
        for b in batches:
            flat, stops = b.column("v").flatten().to_numpy(), b.column("v").offsets.to_numpy()
            stops = stops - stops[0]
            yield pa.RecordBatch.from_arrays([b.column("no"), b.column("ids"), pa.array([flat[i:j].tobytes() for i, j in zip(stops, stops[1:])], pa.binary())],
                                             names=["no", "ids", "v"])

    return checkpoint(found.select(F.col("ids")[0].alias("no"), "ids", "v").mapInArrow(pack, "no long, ids array<long>, v binary"))


def unpack(column: pa.Array, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Cells:
    """Ranges of every component: borders, and the least and largest value of each cell."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.borders, least, most = [], [], []
        for d in range(sample.shape[1]):
            column = np.sort(sample[:, d])
            # cell 0 lies below the sample, the last one above it, the others hold about equal shares of it
            cut = np.unique(np.concatenate((column[(np.arange(cells - 2) * len(column)) // (cells - 2)], [min(int(column[-1]), 2 ** 63 - 2) + 1])))
            self.borders.append(cut)
            least.append(np.concatenate(([low[d]], cut)).astype(np.float64))
            most.append(np.concatenate((cut - 1, [high[d]])).astype(np.float64))
        size = max(map(len, least))
        self.middle, self.half = np.zeros((2, sample.shape[1], size))
        for d, (x, y) in enumerate(zip(least, most)):
            y = np.maximum(x, y)  # an empty outer cell
            self.middle[d, :len(x)], self.half[d, :len(x)] = (x + y) / 2, (y - x) / 2
        self.reach = np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64)))

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, np.uint8)
        for d, cut in enumerate(self.borders):
            out[:, d] = np.searchsorted(cut, rows[:, d], "right")
        return out

    def shapes(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middles, half widths) of approximations."""
        d = np.arange(cells.shape[1])
        return self.middle[d, cells], self.half[d, cells]

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """What rounding in double precision may add to a bound, per query."""
        q = np.abs(queries.astype(np.float64))
        return (q @ self.reach + 1) * (2.0 ** -50 * (queries.shape[1] + 2))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows, cut to the range of long."""
    if np.max(np.abs(x.astype(np.float64)) @ np.ones(x.shape[1]), initial=0) * np.max(np.abs(y.astype(np.float64)), initial=0) < 2 ** 62:
        return np.einsum("ij,ij->i", x, y)
    most = 2 ** 63 - 1
    return np.array([max(-most - 1, min(most, sum(int(a) * int(b) for a, b in zip(p, q)))) for p, q in zip(x, y)], np.int64)


def _largest(value: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Marks of the k largest values of each group."""
    order = np.lexsort((-value, group))
    g = group[order]
    out = np.zeros(len(value), bool)
    out[order[np.arange(len(g)) - np.searchsorted(g, g, "left") < k]] = True
    return out


def _scan(cells: Cells, k: int):
    """Sorted (chunk, slice, kind, no, body) rows, queries before approximations -> (q, c, upper, lower, sure): candidates of
    every query; sure marks the best lower bounds of this group."""
    names = ["q", "c", "upper", "lower", "sure"]

    def run(batches):
        at, numbers, vectors, q, floor, held, size = None, [], [], None, None, [], 0

        def prune():
            """Candidates that can still be answers, with the k best lower bounds of each query so far."""
            c = [np.concatenate(x) for x in zip(*held)]
            sure = _largest(c[3], c[0], k)
            best = np.full(len(floor), -np.inf)
            n = np.bincount(c[0][sure], minlength=len(floor))
            np.minimum.at(low := np.full(len(floor), np.inf), c[0][sure], c[3][sure])
            best[n >= k] = low[n >= k]
            np.maximum(floor, best, out=floor)
            keep = c[2] >= floor[c[0]]
            return [x[keep] for x in c] + [sure[keep]]

        def out():
            if held:
                i, c, upper, lower, sure = prune()
                for s in range(0, len(c), 1 << 16):
                    t = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[i[t]], c[t], upper[t], lower[t], sure[t])], names=names)

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("chunk", "slice", "kind"))))
            for n, (chunk, part, kind) in enumerate(keys):
                if (chunk, part) != at:
                    yield from out()
                    at, numbers, vectors, q, held, size = (chunk, part), [], [], None, [], 0
                no = np.frombuffer(b.column("no")[n].as_py(), np.int64)
                body = b.column("body")[n].as_py()
                if not kind:
                    numbers.append(no)
                    vectors.append(np.frombuffer(body, np.int64).reshape(len(no), -1))
                    continue
                if not len(vectors):
                    continue
                if q is None:
                    numbers, vectors = np.concatenate(numbers), np.concatenate(vectors)
                    q, floor, slack = vectors.astype(np.float64), np.full(len(numbers), -np.inf), cells.slack(vectors)
                middle, half = cells.shapes(np.frombuffer(body, np.uint8).reshape(len(no), -1))
                for s in range(0, len(q), STEP):
                    some = slice(s, s + STEP)
                    m, h = q[some] @ middle.T, np.abs(q[some]) @ half.T + slack[some, None]
                    if len(no) >= k:  # the k-th lower bound of this block is one for all rows
                        floor[some] = np.maximum(floor[some], np.partition(m - h, len(no) - k, axis=1)[:, len(no) - k])
                    i, j = np.nonzero(m + h >= floor[some, None])
                    held.append((i + s, no[j], (m + h)[i, j], (m - h)[i, j]))
                    size += len(i)
                    if size > HELD:
                        kept = prune()
                        size = len(kept[0])
                        if size > HELD // 2:  # too many to hold: hand them on
                            held = [kept[:4]]
                            yield from out()
                            held, size = [], 0
                        else:
                            held = [kept[:4]]
        yield from out()

    return run


def _exact(batches):
    """(q, c, x, y) -> (q, c, score)."""
    for b in batches:
        for s in range(0, b.num_rows, 8192):
            t = b.slice(s, 8192)
            yield pa.RecordBatch.from_arrays([t.column("q"), t.column("c"), pa.array(dot(unpack(t.column("x")), unpack(t.column("y"))))],
                                             names=["q", "c", "score"])


def approximations(classes: DataFrame, cells: Cells) -> DataFrame:
    """The approximation file: rows of (no, body), packed numbers and cells of ``BLOCK`` vectors.  Checkpointed."""
    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                t = b.slice(s, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([t.column("no").to_numpy().tobytes()]), pa.array([cells.of(unpack(t.column("v"))).tobytes()])],
                                                 names=["no", "body"])

    return checkpoint(classes.select("no", "v").mapInArrow(run, "no binary, body binary"))


def _ends(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer of every component over all rows."""
    def run(batches):
        low = high = None
        for b in batches:
            if b.num_rows:
                v = unpack(b.column("v"))
                low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
                high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    rows = classes.select("v").mapInArrow(run, "d long, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").limit(width)
    low, high = zip(*[tuple(r)[1:] for r in rows.collect()])  # one row a component
    return np.array(low, np.int64), np.array(high, np.int64)


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          cells: int = CELLS, first: int = FIRST) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k highest integer inner products of each row that satisfies ``is_query``
    (a condition on ``id``), highest first, ties to the smaller id."""
    spark = table.sparkSession
    rows = whole_numbers(table, id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if size is None:
        return spark.createDataFrame([], EMPTY.format(id_col))
    width = size["w"]
    rows = rows.where(F.size("v") == width)
    classes = classes_of(rows, k)
    sample = classes.orderBy(F.xxhash64("no"), "no").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    shape = Cells(unpack(sample), *_ends(classes, width), cells)

    # every query id, with the class of its vector: known from the ids where the class keeps them, else by the vector
    packed = classes.select("no", F.col("v").alias("x"))
    asked = _with_class(rows.where(is_query), classes)
    seekers = checkpoint(asked.select("no").distinct().join(packed, "no"))

    n_queries = seekers.count()
    chunks = -(-n_queries // CHUNK)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(chunks, 1))
    blocks = approximations(classes, shape).withColumn("slice", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int"))
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1))))
    sought = seekers.select(F.pmod(F.xxhash64("no"), F.lit(max(chunks, 1))).cast("int").alias("chunk"), F.col("no").alias("q"), "x")
    sought = sought.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"), "q", "x")

    def pack(batches):
        for b in batches:
            raw = b.column("q").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("slice"), pa.array([0] * b.num_rows, pa.int32()),
                                              pa.array([x.tobytes() for x in raw], pa.binary()), b.column("x")], names=["chunk", "slice", "kind", "no", "body"])

    met = sought.mapInArrow(pack, "chunk int, slice int, kind int, no binary, body binary").union(
        blocks.select("chunk", "slice", F.lit(1).alias("kind"), "no", "body"))
    met = met.repartition(max(parts * max(chunks, 1), 1), "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind")
    found = checkpoint(met.mapInArrow(_scan(shape, k + 1), "q long, c long, upper double, lower double, sure boolean"))

    # the (k + 1)-th best lower bound over all groups
    by_lower = Window.partitionBy("q").orderBy(F.desc("lower"))
    floor = found.where("sure").withColumn("nth", F.row_number().over(by_lower)).where(F.col("nth") == k + 1).select("q", F.col("lower").alias("floor"))
    left = found.join(floor, "q", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("q", "c", "upper")
    best, more = _refine(checkpoint(left), packed, seekers, k, first * (k + 1))

    ids = classes.select(F.col("no").alias("c"), F.explode("ids").alias(id_col))
    answers = best.join(ids, "c").select("q", "score", id_col)
    # k + 1 classes hold more ids than are wanted: cut before the query ids of a hot vector meet them
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), id_col)
    answers = answers.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1).drop("nth")
    answers = answers.join(asked.select(F.col("id").alias("query_id"), F.col("no").alias("q")), "q").where(F.col(id_col) != F.col("query_id"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, no): the class of each row, met on the packed vector.  Checkpointed."""
    def pack(batches):
        for b in batches:
            flat, stops = b.column("v").flatten().to_numpy(), b.column("v").offsets.to_numpy()
            stops = stops - stops[0]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([flat[i:j].tobytes() for i, j in zip(stops, stops[1:])], pa.binary())], names=["id", "v"])

    return checkpoint(rows.mapInArrow(pack, "id long, v binary").join(classes.select("v", "no"), "v").select("id", "no"))


def _refine(left: DataFrame, packed: DataFrame, seekers: DataFrame, k: int, batch: int) -> tuple[DataFrame, int]:
    """((q, c, score): the k + 1 best of each query by score, then c; rounds): reads candidates exactly, best bound first."""
    sought = seekers.select(F.col("no").alias("q"), F.col("x").alias("y"))
    by_bound = Window.partitionBy("q").orderBy(F.desc("upper"), "c")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best, rounds = None, 0
    while True:
        now = checkpoint(left.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= batch).drop("nth"))
        pairs = now.join(packed.withColumnRenamed("no", "c"), "c").join(sought, "q").select("q", "c", "x", "y")
        read = pairs.mapInArrow(_exact, "q long, c long, score long")
        best = read if best is None else best.union(read)
        best = checkpoint(best.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1))
        rounds += 1
        # certain where the (k + 1)-th score is above every bound that is left
        floor = best.where(F.col("nth") == k + 1).select("q", F.col("score").alias("floor"))
        best = best.drop("nth")
        left = left.join(now.select("q", "c"), ["q", "c"], "left_anti").join(floor, "q").where(F.col("upper") >= F.col("floor")).select("q", "c", "upper")
        left = checkpoint(left)
        if left.isEmpty():
            return best, rounds
        batch *= 4
