"""Manifest against a plain recursion over Python lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from mercata.llm import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, digest string, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, siblings of every node from the bottom up as (left, right))."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for k, members in enumerate(below):
            lo = k - k % 8
            run = nodes[lo:lo + 8]
            for i in members:
                paths[i].append(("".join(run[:k - lo]), "".join(run[k - lo + 1:])))
        below = [sum(below[k:k + 8], []) for k in range(0, len(nodes), 8)]
        nodes = [sha("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        first = leaf([doc_id, source, lang, n_chars, text])
        hurt = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        now = leaf([doc_id, source, lang, n_chars, lowered(text) if hurt else text])
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), first, doc_id, now))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: (sorted(groups[g], key=lambda r: r[:2]),) for g in order}
    made = {g: (r, *tree([x[1] for x in r])) for g, (r,) in made.items()}
    if not made:
        return []
    root, above = tree([made[g][1] for g in order])
    out = []
    for g, up in zip(order, above):
        leaves, subroot, paths = made[g]
        for (_, first, doc_id, now), path in zip(leaves, paths):
            at = now
            for left, right in path + up:
                at = sha(left + at + right)
            out.append((doc_id, first, subroot, root, sha("".join(a + b for a, b in path + up)), at, at == root))
    return sorted(out, key=str)


def audited(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hurt = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    m = manifest.manifest(docs, COLUMNS, "lang", "doc_id", now={"text": F.when(hurt, lower).otherwise(F.col("text"))})
    return sorted((tuple(r) for r in manifest.audit(m).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 600, 5000])
def test_audit_equals_recursion(spark, n):
    rows = [(i * 7 % (n + 3), f"Text É {i} " * (i % 5), [None, "en", "de", "é", ""][min(i % 11, 4)], [None, "s"][i % 2], i, "x", "y", 1) for i in range(n)]
    rows += rows[:3] + [(None, None, None, None, None, None, None, None), (None, "A", "en", None, 3, None, None, None)] * (n > 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert audited(docs) == expected(rows)


def test_persisted_levels_and_paths(spark):
    rows = [(i, "t", "en", "s", 1, None, None, None) for i in range(1200)] + [(5000, "B" * 200_000, "de", "s", 1, None, None, None)]
    m = manifest.manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, "lang", "doc_id")
    assert len(m.rows.levels) == 2  # leaves and every third level above
    assert m.rows.levels[0].count() == 4 and m.rows.levels[1].count() == 1
    want, paths = tree([leaf([i, "s", "en", 1, "t"]) for i in range(1200)])
    got = {r.doc_id: r for r in m.proofs().collect()}
    assert got[7].subroot == want and got[5000].subroot == got[5000].leaf
    for i in (0, 511, 512, 1199):
        assert [tuple(p) for p in got[i].path][:4] == paths[i] and len(got[i].path) == 5
    assert len(got[5000].path) == 1
    assert m.root.first().root == sha(got[5000].leaf + want)


def test_one_group_of_equal_rows(spark):
    rows = [(1, "Same", "en", "s", 4, None, None, None)] * 700
    assert audited(spark.createDataFrame(rows, SCHEMA).repartition(4)) == expected(rows)
