"""Language ID: held-out accuracy, mixtures, odd rows."""

import math
import re

import numpy as np

from mercata.llm import langid, queries


def plain_mixture(text, table):
    """Shares of one text, word by word: EM over all languages, then the best penalised set of the largest shares."""
    n, like = len(table), []
    low = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), text.encode()).lower()
    for m in re.finditer(rb"[a-z\x80-\xff]+", low):
        word, ll = b"\0" + m[0] + b"\0", [0.0] * n
        for k in range(len(word) - 2):
            gram = (word[k] << 16 | word[k + 1] << 8 | word[k + 2]) * 2654435761 % (1 << 32) >> 15
            ll = [x + float(t[gram]) for x, t in zip(ll, table)]
        like.append([math.exp(max(x - max(ll), -60)) for x in ll])
    if not like:
        return [0.0] * n

    def em(share, rounds):
        for _ in range(rounds):
            new = [0.0] * n
            for p in like:
                total = max(sum(a * b for a, b in zip(p, share)), 1e-30)
                new = [x + a * b / total for x, a, b in zip(new, p, share)]
            share = [x / len(like) for x in new]
        return share, sum(math.log(max(sum(a * b for a, b in zip(p, share)), 1e-30)) for p in like)

    share, _ = em([1 / n] * n, langid.ROUNDS)
    order, best = sorted(range(n), key=lambda k: (-share[k], k)), None
    for k in range(1, n + 1):
        part = [max(share[j], 1e-6) if j in order[:k] else 0.0 for j in range(n)]
        part, ll = em([x / sum(part) for x in part], langid.SET_ROUNDS if k > 1 else 0)
        ll -= langid.PENALTY * (k - 1) * 0.5 * math.log(len(like) + 1)
        if best is None or ll > best[1]:
            best = part, ll
    return best[0]


def test_predictions_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    names, table = langid.fit(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text) < 3000]
    assert len(texts) > 40
    for i, text in texts:
        want = plain_mixture(text, table)
        have = {x["lang"]: x["share"] for x in got[i].languages}
        assert np.allclose([have.get(x, 0.0) for x in names], want, atol=2e-3), (i, want, have)
        if max(want) and sorted(want)[-1] - sorted(want)[-2] > 1e-2:
            assert got[i].lang_pred == names[int(np.argmax(want))]


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(k, f"word{chr(97 + k % 9)} text", f"l{k % 9}") for k in range(300)] + [(400 + k, "alpha beta", lang) for k in range(60) for lang in ("zz", "aa")]
    names, table = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(names) == len(table) == 3 and {"aa", "zz"} < set(names)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_langid"](spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_mixture_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.where("doc_id < 600").select("doc_id", "text", "lang").collect()
    en = next(r.text for r in rows if r.lang == "en" and len(r.text) > 2000)
    de = next(r.text for r in rows if r.lang == "de" and len(r.text) > 2000)
    odd = [(9001, None, "en"), (9002, "", None), (9003, "123 !!   😀", None), (9004, en[:2000] + "\n" + de[:2000], None),
           (9005, "Ωμέγα", None), (9006, en * 20, None), (9006, en * 20, None), (None, en, "en")]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang, 0.5) for r in rows] + [(*o, 0.5) for o in odd],
                               "doc_id long, text string, lang string, score double")
    got = langid.languages(df).toPandas()
    assert len(got) == len(rows) + len(odd)
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert [by.lang_pred[k] for k in (9001, 9002, 9003)] == ["und"] * 3
    assert {x["lang"] for x in by.languages[9004]} == {"en", "de"}
    assert all(abs(x["share"] - 0.5) < 0.2 for x in by.languages[9004])
    assert by.lang_pred[9006] == "en" and by.lang_pred[9005] in set(df.toPandas().lang.dropna())
    nothing = langid.languages(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).toPandas()
    assert set(nothing.lang_pred) == {"und"}
    assert langid.languages(df.limit(0)).count() == 0
