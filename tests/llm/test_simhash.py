"""SimHash components against brute force, and the covering property of the anchors."""

import re

import numpy as np
import pyarrow.dataset as ds
import xxhash

from mercata.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, prints=None):
    prints = prints or [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and bin(prints[i] ^ prints[j]).count("1") <= 4:
                    label[i], changed = label[j], True
    first = {}
    for (i, _), c in zip(rows, label):
        first[c] = min(first.get(c, i), i)
    return sorted((i, format(p, "016x"), first[c]) for (i, _), p, c in zip(rows, prints, label))


def test_pairs_within_four_bits_share_an_anchor():
    rng = np.random.default_rng(1)
    table = simhash.covering_table(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    (rx, ax), (ry, ay) = simhash.anchors(x, table, 2), simhash.anchors(y, table, 2)
    for i in range(300):
        assert set(ax[rx == i]) & set(ay[ry == i])
    assert 40 < len(rx) / 300 < 90


def test_odd_thresholds_lose_no_link(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    for bits in (1, 3):
        y = x.copy()
        for i in range(60):
            for b in rng.choice(62, bits, replace=False):
                y[i] ^= 1 << int(b)
        links = simhash.fingerprint_links(spark.createDataFrame([(int(f),) for f in np.concatenate([x, y])], "fp long"), bits)
        assert {tuple(sorted(r)) for r in links.collect()} == {tuple(sorted((int(a), int(b)))) for a, b in zip(x, y)}


def test_spanning_links_connect_what_pairs_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << b) for b in range(40)]))
    links = simhash.spanning_links(fp, 4)
    assert len(links) == len(fp) - 6


def test_odd_rows_match_brute_force(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(5, text), (2, text.upper()), (9, text + " x"), (7, None), (4, ""), (3, " \n\t"), (8, "alone"), (8, "alone"),
            (6, "ein Wort Ärger"), (11, "a b"), (12, "word " * 3000)]
    rows += [(100 + i, " ".join(["lorem ipsum dolor sit amet"] * 40 + [str(i)])) for i in range(30)]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    want = brute_components(rows)
    for hot in (4096, 4):  # the second deals an anchor's fingerprints out as pairs of chunks
        monkeypatch.setattr(simhash, "HOT", hot)
        got = sorted(tuple(r) for r in simhash.simhash_components(df).collect())
        assert got == want
    assert simhash.simhash_components(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_query_matches_brute_force(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in queries.QUERIES["op5_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute_components(list(zip(t["doc_id"], t["text"])))
