"""Quality: held-out accuracy, what co-training teaches, odd rows."""

import re
import zlib

import numpy as np

from mercata.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_quality"](spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.97
    assert got[["score", "text_score", "meta_score"]].stack().between(0, 1).all()


def sorted_pool(views_u, ids=None):
    """``surest`` over rows in memory: sort all, take one by one."""
    free = set(range(len(views_u[0])))
    ids = list(range(len(views_u[0]))) if ids is None else ids

    def surest(score, wanted):
        out = []
        for p in score(views_u):
            out.append({})
            for label, most in wanted.items():
                sure = p if label else 1 - p
                rows = sorted((k for k in free if sure[k] >= quality.SURE), key=lambda k: (-sure[k], ids[k]))[:most]
                free.difference_update(rows)
                out[-1][label] = [v[rows] for v in views_u]
        return out

    return surest


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.6).astype(float)
    a = y[:, None] * 2 + rng.normal(size=(3000, 4))
    b = y[:, None] * 2 + rng.normal(size=(3000, 3))
    model = quality.co_train([a[:60], b[:60]], y[:60], sorted_pool([a[60:2000], b[60:2000]]))
    assert min(model["taught"]) > 100
    *_, score = quality.predict(model, [a[2000:], b[2000:]])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.95


def plain_features(text, source, lang):
    """The features of one document, written out."""
    data = (text or "").encode()
    size, words, lines = len(data), re.findall(rb"[0-9A-Za-z\x80-\xff]+", data), [x for x in re.split(rb"[\r\n]+", data) if x]
    words = [re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), w).lower() for w in words]
    classes = [*quality.CLASSES, bytes(set(range(256)) - set(b"".join(quality.CLASSES)))]
    n, m, kinds = max(len(words), 1), max(len(lines), 1), len(set(words))
    low = {re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda g: b"\xc3" + bytes([g[1][0] + 32]), x).lower() for x in lines}
    out = [sum(c in k for c in data) / max(size, 1) for k in classes]
    out += [np.log1p(sum(map(len, words)) / n), sum(len(w) <= 2 for w in words) / n, kinds / n, kinds / n * np.log(n + 1), 1 - len(low) / m]
    out += [np.log1p(size), np.log1p(m), np.log1p(size / m)]
    return out + [zlib.crc32((source or "").encode()) % quality.SOURCES, zlib.crc32((lang or "").encode()) % quality.LANGS]


def test_scores_equal_plain_python(spark, monkeypatch):
    """Features, teaching over all unlabelled rows and scores against loops over one document at a time."""
    monkeypatch.setattr(quality, "PER_ROUND", 25)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang")
    odd = [(9001, None, None, None), (9002, "", "s", "xx"), (9003, "\r\n\n", "s", "en"), (9004, "Ünï ÉCOLE ünï\nécole\nÉCOLE", "s", "de"), (9005, "a" * 300_000, "s", "en")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    rows = docs.collect()
    x = np.array([plain_features(r.text, r.source, r.lang) for r in rows], np.float32)
    known = {r.doc_id: r.quality for r in labels.collect()}
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    learn = [k for k, r in enumerate(rows) if zlib.crc32(str(r.doc_id).encode()) % 5]
    taught = sorted((k for k in learn if rows[k].doc_id in known), key=lambda k: order[rows[k].doc_id])
    pool = [k for k in learn if rows[k].doc_id not in known]
    assert len(pool) > 30 and len(taught) > 30
    model = quality.co_train(quality.views(x[taught]), np.array([float(known[rows[k].doc_id]) for k in taught]),
                             sorted_pool(quality.views(x[pool]), [order[rows[k].doc_id] for k in pool]))
    assert max(model["taught"]) > 0
    want = dict(zip((r.doc_id for r in rows), zip(*quality.predict(model, quality.views(x)))))
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.text_score, r.meta_score, r.score), want[r.doc_id], atol=1e-3), r


def test_rows_of_one_id_teach_once_and_alike(spark):
    base = [(i, ("Good prose here, and more of it. " * 5) if i % 2 else "BUY!! NOW!! " * 9, f"s{i % 3}", "en") for i in range(200)]
    twice = [(i, "Other text of this number " * (1 + i % 7), "s", "en") for i in range(0, 200, 3)]
    schema = "doc_id long, text string, source string, lang string"
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    runs = []
    for rows in (base + twice, (twice + base)[::-1]):
        got = quality.quality(spark.createDataFrame(rows, schema).repartition(3 + len(runs)), labels)
        runs.append(sorted((r.doc_id, round(r.score, 9)) for r in got.collect()))
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, ("Good prose here, and more of it. " * 5) if i % 2 else "BUY!! NOW!! " * 9, f"s{i % 3}", "en", 1) for i in range(200)]
        + [(900, None, None, None, 1), (901, "", "s", "xx", 1), (902, "word " * 40_000, "s", "en", 1), (902, "word " * 40_000, "s", "en", 1), (None, "x", "s", "en", 1)],
        "doc_id long, text string, source string, lang string, label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)] + [(1, 1), (3, None), (5, 9)], "doc_id long, quality int")
    got = quality.quality(docs, labels).toPandas()
    assert len(got) == 205
    known = got[got.doc_id < 200].set_index("doc_id")
    assert (known.predicted == known.index % 2).mean() > 0.97
    assert set(quality.quality(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert set(quality.quality(docs, labels.where("quality = 1")).toPandas().score) == {1.0}
    assert quality.quality(docs.limit(0), labels).count() == 0
