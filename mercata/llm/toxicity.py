"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (31 bits) of its lower-cased words, adjacent pairs, and pairs
with one word between them.  Training is FTRL-proximal with per-coordinate rates and L1 and L2 terms on
a bounded sample of labelled rows (``TRAIN_ROWS``, smallest hashes of the id; one task reads them); a
feature must occur in ``MIN_ROWS`` of them.  L1 leaves few non-zero weights, at most one per feature of
the sample; they are the only thing that reaches the scoring tasks.

Scoring reads every whole text once, in vectorised blocks, without a shuffle.

Defined cases: null text is empty; an empty text scores the bias alone; labels that are null or neither
0 nor 1 are not learned; several labels of one id count as the largest, several texts of one id as the
smallest text; without any usable label every score is 0; repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.llm.common import mix, prefix_sums, range_hash, spans, text_blocks

TRAIN_ROWS, MIN_ROWS, EPOCHS = 12_288, 8, 3
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 1.0
#: Power of the ratio of negative to positive rows by which a positive row counts more.
BALANCE = 0.5


def word_bytes() -> np.ndarray:
    """Letters, digits and every byte of a multi-byte character."""
    inside = np.zeros(256, bool)
    inside[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
    inside[128:] = True
    return inside


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital letters of Latin-1 in UTF-8 (a copy)."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 32
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, pair and skip pair; repeats included."""
    data = lower(data)
    start, end, doc = spans(data, offsets, word_bytes()[data])
    h = range_hash(prefix_sums(data), start, end)
    out, docs = [h], [doc]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = doc[gap:] == doc[:-gap]
        out.append(mix(h[:-gap][same] * np.uint64(factor) + h[gap:][same]))
        docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(33)).astype(np.int32)


def text_features(column: pa.Array) -> list[np.ndarray]:
    """Distinct features of each text, ascending."""
    out = []
    for i, j, data, off in text_blocks(column):
        doc, f = features(data, off)
        key = np.unique((doc.astype(np.int64) << 31) | f)
        cut = np.searchsorted(key >> 31, np.arange(j - i + 1))
        f = (key & 0x7FFFFFFF).astype(np.int32)
        out += [f[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Weights of ``size`` features; the last position is the bias, which has no L1."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0, (np.sign(zi) * l1[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rows = [np.append(r, size) for r in rows]
    positive = max(1.0, labels.sum())
    rate = np.where(labels > 0, max(1.0, (len(labels) - positive) / positive), 1.0) ** BALANCE
    for _ in range(EPOCHS):
        for i, y, c in zip(rows, labels, rate):
            w = weights(i)
            g = c * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def _train(batches):
    rows, labels = [], []
    for b in batches:
        rows += text_features(b.column("text"))
        labels += b.column("label").to_pylist()
    names = ["feature", "weight"]
    if not rows:
        return
    every, count = np.unique(np.concatenate(rows), return_counts=True)
    every = every[count >= min(MIN_ROWS, max(1, len(rows) // 50))]
    known = []
    for r in rows:
        at = np.searchsorted(every, r)
        at[at == len(every)] = 0
        known.append(at[every[at] == r] if len(every) else at[:0])
    w = ftrl(known, np.array(labels, float), len(every))
    keep = np.flatnonzero(w[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(every[keep], -1).astype(np.int32)),
                                      pa.array(np.append(w[keep], w[-1]))], names=names)


def learnable(id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learned from a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label_col).isin(0, 1) & learnable(id_col)).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS)
    text = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(sample), id_col)
    one = text.groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    one = one.repartition(1).sortWithinPartitions(F.xxhash64(id_col), id_col).select("text", "label")
    model = one.mapInArrow(_train, "feature int, weight double").toPandas()
    if not len(model):
        return np.zeros(0, np.int32), np.zeros(0), -40.0
    return model.feature.to_numpy()[:-1], model.weight.to_numpy()[:-1], float(model.weight.iloc[-1])


def score_texts(column: pa.Array, feature: np.ndarray, weight: np.ndarray, bias: float, maybe: np.ndarray) -> np.ndarray:
    out = np.full(len(column), bias)
    for i, j, data, off in text_blocks(column):
        doc, f = features(data, off)
        hit = maybe[f & 0xFFFFF]
        doc, f = doc[hit], f[hit]
        at = np.searchsorted(feature, f)
        at[at == len(feature)] = 0
        hit = feature[at] == f if len(feature) else np.zeros(len(f), bool)
        key = np.unique((doc[hit].astype(np.int64) << 32) | at[hit])
        out[i:j] += np.bincount(key >> 32, weight[key & 0xFFFFFFFF], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of docs plus ``out_col``, a double from 0 to 1."""
    feature, weight, bias = model
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches):
        maybe = np.zeros(1 << 20, bool)
        maybe[feature & 0xFFFFF] = True
        for b in batches:
            s = score_texts(b.column(text_col), feature, weight, bias, maybe)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    model = fit(docs, labels, "toxic", id_col, text_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (~F.coalesce(learnable(id_col), F.lit(False))).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below ``least``; all columns."""
    feature, weight, bias = fit(docs, labels, "toxic", id_col, text_col)

    def run(batches):
        maybe = np.zeros(1 << 20, bool)
        maybe[feature & 0xFFFFF] = True
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(text_col), feature, weight, bias, maybe) < least))

    return docs.mapInArrow(run, docs.schema)
