"""Nearest neighbours: exact scores and order, recall against brute force, odd vectors."""

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from mercata.llm import ann, queries


def brute(ids, m, q, k):
    s = (m * m[ids == q][0]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [(int(ids[i]), s[i]) for i in order]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_query(spark, sf):
    t = ds.dataset(f"/root/testdata/{sf}/embeddings.parquet").to_table().to_pydict()
    ids, m = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    rows = queries.QUERIES["op1_ann"](spark, f"/root/testdata/{sf}").collect()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        want = brute(ids, m, q, 20)
        hits += len({r.vec_id for r in mine} & {i for i, _ in want})
        total += len(want)
        for r in mine:
            assert r.score == pytest.approx((m[ids == q][0] * m[ids == r.vec_id][0]).sum(), abs=1e-12)
    assert hits / total >= 0.9


def test_odd_vectors_ties_and_repeats(spark):
    good = [(i, [float(i % 5), 1.0]) for i in range(1, 60)]
    odd = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, [None, 1.0]), (105, []), (106, [1.0])]
    rows = good + good[:3] + odd
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, id long")
    got = ann.nearest(df, F.col("id") % 20 == 0, 20).collect()
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    assert {r.query_id for r in got} == {20, 40}
    for q in (20, 40):
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert mine == brute(ids, m, q, 20)  # everything equal in score goes to the smaller id
    few = ann.nearest(df.where("vec_id <= 3"), F.col("id") == 1, 20).collect()
    assert sorted(r.vec_id for r in few) == [2, 3]
    assert ann.nearest(df.limit(0), F.col("id") == 1).count() == 0
    assert ann.nearest(df.where("vec_id >= 100 AND vec_id < 106"), F.col("id") > 0).count() == 0


@pytest.mark.parametrize("chunk_rows", [1 << 14, 1000])
def test_many_tied_vectors_go_to_the_smaller_ids(spark, chunk_rows):
    # all vectors but the query's score the same; both leaves are probed, so every row is compared
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i), float(-i * i)]) for i in range(1, 7316)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") == 0, 20, trees=1, depth=1, probes=2, chunk_rows=chunk_rows).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") == 1, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 3.0), (2, 2.0), (3, 1.0)]
