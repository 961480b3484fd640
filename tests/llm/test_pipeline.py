"""The pipeline against the stages' brute-force definitions, and on odd tables."""

import difflib
import math
import re

import numpy as np
import pyarrow.dataset as ds
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from mercata.llm import pieces, toxicity
from tests.llm.test_decontaminate import plain
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def table(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


def test_stage_order_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "decontamination", "sentencepiece"]


def lowered(data):
    return re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), data).lower()


def word_list(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", lowered((text or "").encode()))


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def plain_toxicity(text, weights, bias):
    """The score of one text from its words, pairs and pairs with a word between."""
    h = [mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64)) for w in word_list(text)]
    found = set(h)
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        found |= {mixed((x * factor + y) % (1 << 64)) for x, y in zip(h, h[gap:])}
    return 1 / (1 + math.exp(-bias - sum(weights.get(f, 0.0) for f in {x >> 33 for x in found})))


def fewest_edits(item, text):
    """Edits between the item and the part of the text nearest to it."""
    row, step = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (text != c), row[1:] + 1)))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def numbers(words, known):
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def holds(item, text):
    """Whether a normalised item occurs within its budget: one of budget + 1 equal parts must occur unchanged."""
    m = len(item)
    if m < 8:
        return False
    e = min(int(0.1 * m), (m - 8) // 8)
    cuts = [k * m // (e + 1) for k in range(e + 2)]
    if not any(item[x:y] in text for x, y in zip(cuts, cuts[1:])):
        return False
    return fewest_edits([ord(c) for c in item], np.array([ord(c) for c in text])) <= e


def check_cuts(before, after, order):
    """Every repeated 50-word window stays once; what was cut resembles another text at 0.8; all else is untouched."""
    known = {}
    words = {i: numbers(word_list(t), known) for i, t in before.items()}
    left, shared, cut = {i: word_list(t) for i, t in after.items()}, {}, 0
    for i, w in words.items():
        for k in range(len(w) - 49):
            shared.setdefault(w[k:k + 50].tobytes(), set()).add(i)
    open_windows = {}
    for i, w in left.items():
        w = numbers(w, known)
        for k in range(len(w) - 49):
            open_windows.setdefault(w[k:k + 50].tobytes(), set()).add(i)
    for key, holders in shared.items():
        first = min(holders, key=order.get)
        assert open_windows.get(key, set()) <= {first}
    for i, text in before.items():
        if text == after.get(i):
            continue
        cut += 1
        kept = numbers(left.get(i, []), known)
        runs = difflib.SequenceMatcher(None, words[i].tolist(), kept.tolist(), autojunk=False).get_opcodes()
        assert {x[0] for x in runs} <= {"equal", "delete"}
        for _, x, y, _, _ in (r for r in runs if r[0] == "delete"):
            assert y - x >= 50
            # pieces of a run that several passages make are tested one by one
            for k in range(x, y - 49, 50):
                part = words[i][k:k + 50]
                near = min(fewest_edits(part, words[j]) for j in before if j != i and order[j] < order[i] and len(words[j]) >= 40)
                assert near <= 25, (i, k, near)
    return cut


def test_stages_match_independent_results(spark, monkeypatch, tmp_path):
    """Ids and texts of every stage against plain Python over that stage's input."""
    kept = {}

    def traced(name, stage):
        def run(spark, docs, sf_dir):
            kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            return stage(spark, docs, sf_dir)
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [traced(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, SF, str(tmp_path / "run")).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    feature, weight, bias = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    weights = dict(zip(feature.tolist(), weight.tolist()))
    assert kept["toxicity"] and sorted(kept["simhash"]) == sorted((i, t) for i, t in kept["toxicity"] if plain_toxicity(t, weights, bias) < 0.5)
    assert len(kept["simhash"]) < len(kept["toxicity"])

    first = {c for _, _, c in brute_components(kept["simhash"])}
    assert sorted(kept["substring"]) == sorted((i, t) for i, t in kept["simhash"] if i in first)

    rank = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) h").collect()}
    order = {i: (len(word_list(t)), rank[i]) for i, t in kept["substring"]}
    assert check_cuts(dict(kept["substring"]), dict(kept["decontamination"]), order) > 0

    items = [plain(r["text"]).strip() for r in table("benchmark")]
    clean = sorted((i, t) for i, t in kept["decontamination"] if not any(holds(x, plain(t)) for x in items))
    assert sorted(kept["sentencepiece"]) == clean and len(clean) < len(kept["decontamination"])

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sorted((r.doc_id, r.text) for r in out) == clean
    assert all(list(r.ids) == sp.encode(r.text) for r in out if r.text and "▁" not in r.text)


def test_a_lost_run_goes_on_where_it_stopped(spark, monkeypatch, tmp_path):
    calls, broken = [], [True]

    def stage(name):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if name == "c" and broken:
                raise RuntimeError("lost")
            return docs.where(f"doc_id % 5 <> {len(calls) % 5}")
        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(n) for n in "abcd"])
    folder = tmp_path / "run"
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, str(folder))
    assert [p.name for p in folder.iterdir()] == ["1-b"]
    broken.clear()
    assert corpus_pipeline.run(spark, SF, str(folder)).count() > 0
    assert calls == ["a", "b", "c", "c", "d"] and [p.name for p in folder.iterdir()] == ["3-d"]


@pytest.fixture
def odd(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    extra = spark.createDataFrame([(7001, None, None, None, None), (7002, "", "en", "s", 0), (None, "text without id", "en", "s", 15),
                                   (7003, "short", "en", "s", 5), (7003, "short", "en", "s", 5)], docs.schema)
    rows = docs.union(extra).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("_cut", F.lit(2))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return rows, str(tmp_path)


def test_filter_stages_on_odd_and_empty_tables(spark, odd):
    rows, sf_dir = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns
        kept = [r.doc_id for r in out.collect()]
        assert {7003, None} <= set(kept), name
        if name == "simhash":  # null and empty texts are one component; a repeated row stays once
            assert kept.count(7003) == 1 and (7001 in kept) != (7002 in kept)
        else:
            assert {7001, 7002} <= set(kept) and kept.count(7003) == 2
        assert stage(spark, rows.limit(0), sf_dir).count() == 0
