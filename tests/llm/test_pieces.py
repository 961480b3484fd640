"""SentencePiece: the library's ids for both model types, exact decoding, odd rows."""

import pyarrow.dataset as ds
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from mercata.llm import pieces

ODD = ["", " ", "  ", " a  b   c    d ", "aaaa aaaaaaa", "x" * 300, "\n\n  \n   z", "hello²., ½", "日本 語😀😀", "tab\there", "a b", "Ünïcödé çédille",
       "1234567 89", "\u0000\u0001", "the the the the the"]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(pieces.default_model(), "rb").read())
    proto.trainer_spec.model_type = 1
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts():
    return ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().column("text").to_pylist() + ODD


def rows(spark, model):
    data = [(i, t, "x", 1) for i, t in enumerate([*texts(), None, "a ▁ b▁▁", "long" * 20_000])]
    df = spark.createDataFrame(data, "doc_id int, text string, piece string, score int")
    return data, pieces.decode(pieces.encode(df, model), model).toPandas().set_index("doc_id")


def test_ids_are_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LEAST_COUNT", 1)  # most segments go the relational way
    model = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    data, got = rows(spark, model)
    assert len(got) == len(data)
    for i, t, *_ in data:
        if t is None:
            assert got.ids[i] is None and got.decoded[i] is None
            continue
        assert got.decoded[i] == t
        if "▁" not in t:
            assert list(got.ids[i]) == sp.encode(t), t[:60]


def test_unigram_paths_score_at_least_the_librarys(spark, unigram, monkeypatch):
    monkeypatch.setattr(pieces, "LEAST_COUNT", 1)
    model = pieces.Model(unigram)
    assert not model.merges
    sp = sentencepiece.SentencePieceProcessor(model_file=unigram)
    score = {i: s for i, s in model.piece.values()}
    total = lambda ids: sum(score.get(i, -1e6) for i in ids)
    data, got = rows(spark, unigram)
    same = n = 0
    for i, t, *_ in data:
        if t is None or "▁" in t:
            continue
        assert got.decoded[i] == t
        if t.isascii() and "  " not in t and t.isprintable() and t == t.strip() and t:
            n += 1
            same += list(got.ids[i]) == sp.encode(t)
            assert total(got.ids[i]) >= total(sp.encode(t)) - 1
    segment = "▁internationalisation"
    assert total(model.viterbi(segment)) >= total(model.merge(segment))


def test_relational_and_local_rules_agree(spark, unigram):
    words = sorted({w for t in texts() for w in (t or "").split() if 0 < len(w) <= 24})[:400] + ["▁" + "ab" * 5, "é😀x"]
    df = spark.createDataFrame([(w,) for w in words], "segment string")
    for path in (pieces.default_model(), unigram):
        m = pieces.Model(path)
        table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in m.piece.items()], "piece string, id int, score double")
        out = pieces.merged_paths(df, table, m.longest) if m.merges else pieces.best_paths(df, table, m.longest, m.unknown)
        for r in out.collect():
            ids = [x for p in r.path for x in ([p] if p >= 0 else m.spell(r.segment[-1 - p]))]
            assert ids == m.path(r.segment)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert pieces.encode(df, pieces.default_model()).count() == 0
