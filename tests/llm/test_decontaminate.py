"""Decontamination: alignment against brute force, no occurrence within the budget is missed."""

import random
import tracemalloc

import numpy as np
import pyarrow.dataset as ds

from mercata.llm import decontaminate as dc
from mercata.llm import queries

SF = "/root/testdata/sf0.01"


def distance(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = "q"
        elif kind < 0.7:
            out.insert(k, "z")
        else:
            out.pop(k)
    return "".join(out)


def test_align_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randint(1, 4) for _ in range(rng.randint(5, 30))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 8))] + item[: rng.randint(3, len(item))] + [rng.randint(1, 4) for _ in range(5)]
        edits, x, y = dc.align(np.array(item, np.uint32), np.array(text, np.uint32), -len(item), len(text))
        assert edits == distance(item, text) == distance(item, text[x:y])


def test_every_occurrence_within_the_budget_is_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(20)]
    docs, want = [], {}
    for d in range(150):
        item, text = rng.choice(items)
        n = rng.randint(0, int(0.14 * len(text)))
        body = edited(rng, text, n)
        whole = " ".join([word() for _ in range(rng.randint(0, 60))] + [body] + [word() for _ in range(rng.randint(0, 30))])
        docs.append((d, whole.upper() if d % 3 == 0 else whole.replace(" ", " -- \n", 3)))
        want[d] = (item, distance(text, " ".join(whole.split())) <= int(0.1 * len(text)))
    docs += [(900, None), (901, ""), (902, items[0][1][:20]), (903, "x" * 200_000 + " " + items[1][1] + " " + items[1][1]), (904, items[2][1]), (904, items[2][1])]
    odd = [(50, None), (51, ""), (52, "ab c"), (53, items[2][1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + odd, "item_id long, text string")
    got = dc.matches(df, bench).collect()
    hits = {(r.doc_id, r.item_id) for r in got}
    for d, (item, within) in want.items():
        assert not within or (d, item) in hits
    for r in got:
        text = dict(docs)[r.doc_id]
        item = dict(items + odd)[r.item_id]
        part = " ".join(text[r.start:r.end].lower().replace("--", " ").split())
        assert r.edits <= int(0.1 * len(item)) and distance(item, part) == r.edits
    assert {i for d, i in hits if d == 904} >= {2, 53}
    assert sum(r.doc_id == 903 for r in got) == 2 and 902 not in {d for d, _ in hits}
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in hits})
    assert dc.matches(df, bench.limit(0)).count() == 0 and dc.matches(df.limit(0), bench).count() == 0
    assert dc.decontaminate(df, bench.limit(0)).count() == df.count()


def plain(text):
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return "".join(map(chr, dc.normalise(raw, np.array([0, len(raw)]))[0]))


def test_letters_numbers_and_marks_of_any_script():
    assert plain("你好。世界，𠀀！") == "你好 世界 𠀀 "
    assert plain("A😀😀b\U000e0041c") == "a b c"
    assert plain("हिन्दी भाषा।") == "हिन्दी भाषा "
    assert plain("Über-Straße 12½") == "über straße 12½"


def test_memory_follows_the_hits_and_not_the_length():
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, 200))) for _ in range(512)]
    items = dc.Items(list(range(512)), texts, dc.Q, dc.RATE)
    long = rng.integers(97, 123, 2_000_000).astype(np.uint32)
    long[1_000_000:1_000_200] = [ord(c) for c in texts[77]]
    key = dc.grams(long)
    tracemalloc.start()
    found = list(dc.regions(long, np.array([0, len(long)]), key, np.ones(len(key), bool), items, items.maybe()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, _, _ in found] == [77] and found[0][1] <= 1_000_000 <= found[0][2]
    assert peak < 40_000_000


def test_query_finds_every_exact_passage(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    b = ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pydict()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    exact = {(d, i) for d, text in zip(t["doc_id"], t["text"]) for i, item in zip(b["item_id"], b["text"]) if item in text}
    assert exact <= got
