"""Exact search against brute force in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.llm import queries, vafile

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k, divisor):
    kept = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(max(-2 ** 63, min(2 ** 63 - 1, math.floor(256 * float(np.float32(x))))) for x in v)
        kept[i] = min(kept.get(i, whole), whole)
    sizes = [len(v) for v in kept.values()]
    width = min(sorted(set(sizes)), key=lambda n: (-sizes.count(n), n), default=0)
    kept = {i: v for i, v in kept.items() if len(v) == width}
    out = []
    for q in (i for i in kept if i % divisor == 0):
        scores = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(kept[q], v)))), i) for i, v in kept.items() if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def searched(spark, rows, k=5, divisor=50, **more):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in vafile.top_k(table, F.col("id") % divisor == 0, k, **more).collect())


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op12_vafile(spark, "/root/testdata/sf0.001").collect()) == brute(rows, 5, 50)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(400)]  # many equal vectors, many ties
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0, 0.0, -1.0]) for i in range(300)]  # a hot vector
    rows += rows[:20] + [(7, [1.0] * 6), (None, [1.0] * 6), (2000, None), (2050, []), (2100, [None] * 6), (2150, [float("nan")] * 6),
                         (2200, [float("inf")] * 6), (2250, [1.0, 2.0]), (2300, [0.0] * 6), (-50, [0.5] * 6)]
    assert searched(spark, rows) == brute(rows, 5, 50)
    assert searched(spark, rows, k=30, divisor=7, cells=4, first=1) == brute(rows, 30, 7)


def test_outliers_huge_values_and_few_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    rows[100] = (100, [1e30, -1e30, 3e38, 0.0, 1.0])
    rows[150] = (150, [1e6, 0.0, 0.0, 0.0, 0.0])
    rows[151] = (151, [-1e12, 1e12, 0.0, 0.0, 0.0])
    assert searched(spark, rows) == brute(rows, 5, 50)
    assert searched(spark, rows[:3]) == brute(rows[:3], 5, 50)
    assert searched(spark, rows[:1]) == [] and searched(spark, []) == [] and searched(spark, rows[1:9]) == []


@pytest.mark.parametrize("held", [1, 200])
def test_small_blocks_and_many_groups(spark, monkeypatch, held):
    for name, value in (("BLOCK", 16), ("STEP", 7), ("CHUNK", 5), ("HELD", held), ("SAMPLE_ROWS", 50)):
        monkeypatch.setattr(vafile, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(500)]
    assert searched(spark, rows, divisor=20) == brute(rows, 5, 20)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-120, 120, (2000, 16))
    cells = vafile.Cells(v[:300], v.min(axis=0), v.max(axis=0))
    middle, half = cells.shapes(cells.of(v))
    q = v[:40].astype(float)
    score, m, h = q @ v.T, q @ middle.T, np.abs(q) @ half.T
    assert np.all(m - h <= score) and np.all(score <= m + h)
    lower = np.sort(m - h, axis=1)[:, -6]
    assert np.mean(m + h >= lower[:, None]) < 0.1
