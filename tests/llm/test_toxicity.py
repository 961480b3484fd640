"""Toxicity: held-out accuracy, odd rows, FTRL against a plain reference."""

import numpy as np
import pytest

from mercata.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() >= 0.96
    assert got.toxic[got.predicted == 1].mean() >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"you are {'an idiot' if i % 2 else 'very kind'} friend number {i}", "a") for i in range(1, 200)]
                                 + [(500, None, "b"), (501, "", None), (502, "idiot " * 50_000, "c"), (502, "idiot " * 50_000, "c"), (None, "idiot", "d")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(1, 1), (500, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == 204
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by.predicted[502] == 1 and by.predicted[500] == by.predicted[501]
    known = by.loc[1:199]
    assert (known.predicted == known.index % 2).mean() > 0.95
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert 502 not in {r.doc_id for r in kept.collect()}
    none = toxicity.toxicity(docs, labels.limit(0)).toPandas()
    assert len(none) == 204 and not none.predicted.any()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_ftrl_formula():
    rows, y = [np.array([0, 1]), np.array([1, 2]), np.array([0])] * 40, np.array([1.0, 0.0, 1.0] * 40)
    z, n = np.zeros(4), np.zeros(4)

    def weight(i):
        l1 = toxicity.L1 if i < 3 else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for r, t in zip(rows, y):
            at = [*r, 3]
            p = 1 / (1 + np.exp(-sum(weight(i) for i in at)))
            ws = [weight(i) for i in at]
            for i, w in zip(at, ws):
                g = p - t
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w
                n[i] += g * g
    assert toxicity.ftrl(rows, y, 3) == pytest.approx([weight(i) for i in range(4)])
