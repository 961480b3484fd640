"""Alignment of two tokenizers: whole texts encoded at once and compared byte range by byte range."""

import hashlib
from collections import Counter

import pytest

from mercata.llm import alignment, queries
from mercata.llm.common import written

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "a ", " a", "\n", "a\n b\n\nc  d\t e", "don't  'll", "</s> <s> <unk> <0x0A> <|endoftext|>", "x ▁ y", "▁", "日本語 テキスト、 。", "👩‍👩‍👧 family",
       "ü ñ é ﬁ", "  a b   c", "\x00 z", "a" * 500, "ab " * 700, "१२३ हिन्दी", "1234567 89", "\r\n \r\n", "it's 'tis o'clock's (a)b-c_d `e` f\ng\n\nh\n i", "naïve œuvre, Straße! ő.a ’s x’s", "-a- --b 1a a1 a.b.c \tq", "ab\nÉcole\nőr", "᠎ b ﻿ c", "a ​ b"]


def plain(texts, encoders):
    """Per text: (A ids, B ids, groups, links) from one call of each library, or None."""
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = encoders.a.encode(" " + text, add_special_tokens=False).ids, encoders.whole.encode(text)
        if not encoders.gives_back(" " + text, a, b):
            out.append(None)
            continue
        spans = []
        for ids, raw in ((a, encoders.a_bytes), (b, encoders.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(raw[i])))
                at += len(raw[i])
            spans.append(own)
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups = ["|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if lo <= s and e <= hi) for ids, own in zip((a, b), spans))
                  for lo, hi in zip([0, *sorted(both)], sorted(both))]
        starts, linked = spans[1], []
        for i, (s, e) in zip(a, spans[0]):
            linked += [(i, j) for j, (x, y) in zip(b, starts) if x < e and s < y]
        out.append((a, b, ";".join(groups), linked))
    return out


def expected(ids, texts, encoders):
    rows = plain(texts, encoders)
    n = Counter(p for r in rows if r for p in r[3])
    most = {}
    for (_, b), c in n.items():
        most[b] = max(c, most.get(b, 0))
    out = []
    for i, r in zip(ids, rows):
        out.append((i, 0, 0, 0, 0, 0, 0, "") if r is None else (
            i, len(r[0]), len(r[1]), r[2].count(";") + 1, len(r[3]), sum(n[p] == most[p[1]] for p in r[3]), sum(n[p] for p in r[3]),
            hashlib.sha256(r[2].encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece

    out = alignment.Encoders(*alignment.default_files())
    out.whole = sentencepiece.SentencePieceProcessor(model_proto=alignment.default_files()[1])  # as the file says
    return out


def test_query_equals_whole_text_encoding(spark, encoders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_alignment(spark, SF).collect()}
    every = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(every)
    for (i, text) in docs:  # sums over the corpus are held in the next test
        r = plain([text], encoders)[0]
        assert got[i][1:5] + got[i][7:] == (len(r[0]), len(r[1]), r[2].count(";") + 1, len(r[3]), hashlib.sha256(r[2].encode()).hexdigest())


@pytest.mark.parametrize("table", [0, 60, 1 << 20])
def test_counts_odd_texts_repeats_and_clashing_names(spark, encoders, table):
    from pyspark.sql import functions as F
    some = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").limit(25).collect()]
    texts = ODD + some + some[:3]
    ids = [None if i == 4 else i // 2 for i in range(len(texts))]  # null and repeated ids
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(texts)))), "doc_id long, text string, _row long").repartition(3)
    files = alignment.default_files()
    rows = alignment.aligned(docs, files, keep=["doc_id"])
    rows = written(rows.withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups"), "test")
    rows = alignment.with_counts(rows, alignment.link_counts(rows), table)
    got = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ids, texts, encoders)
    kept = alignment.aligned(docs, files)  # other columns stay, clash or not with inner names
    assert kept.columns[:2] == ["doc_id", "_row"] and kept.count() == len(texts)
    with pytest.raises(ValueError):
        alignment.aligned(docs.withColumn("groups", F.lit(1)), files)


def test_memo_and_portions_start_over(spark, encoders, monkeypatch):
    texts = ["alpha beta, gamma " * 40, "one  two\n three " * 30 + "▁", "x y z " * 50]
    whole = expected(range(3), texts, encoders)
    monkeypatch.setattr(alignment, "PORTION", 20)
    monkeypatch.setattr(alignment, "HELD", 5)
    assert [s for p in encoders.stretches(texts[0]) for s in p] == ["" + s for s in __import__("re").findall(alignment.STRETCH, " " + texts[0])]
    monkeypatch.setattr(alignment, "BLOCK", 3)
    memo = alignment.Memo(encoders)
    at, ends = memo.numbers(texts)
    sizes = memo.per_text(memo.sizes, at, ends)
    assert [tuple(x[:4]) for x in sizes[[0, 2]].tolist()] == [w[1:5] for w in whole if w[0] in (0, 2)]
    assert sizes[1][4] > 0


def test_empty_table(spark):
    rows = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), alignment.default_files())
    assert alignment.with_counts(rows, alignment.link_counts(rows)).count() == 0
