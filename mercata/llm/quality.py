"""Quality classifier by co-training of two views.

Text view: shares of byte classes, word lengths, distinct words and repeated lines of the whole text.
Metadata view: source, language tag, and the page layout (bytes, lines, bytes a line).  Each view has a ridge
logistic regression.  They start from a bounded sample of labelled rows and teach each other over ``ROUNDS``:
each round every view scores all unlabelled documents and labels those of which it is surest, at most
``PER_ROUND`` at the class ratio of the labels and at a confidence of at least ``SURE``, and the other view learns
from them.  A held-back part of the labelled sample calibrates each view (Platt), and a logistic regression on it
combines the calibrated views, whose score is given to every document in one pass without a shuffle.

Sample bound: ``LABELLED`` labelled rows, smallest hashes of the id.  Labelled and unlabelled rows are outside the
held-out fold (crc32 of the id as text divisible by 5).  The features of all of them, 100 bytes a document, are
written once; a round reads them, each task keeps its surest rows, and the surest of all tasks reach the driver
(twice ``PER_ROUND`` a view and label at most).

Defined cases: null text, source or language count as empty; labels neither 0 nor 1 are not learned, several
labels of an id count as the largest; several rows of an id teach as the one with the smallest feature bytes; rows
with null id do not teach; with labels of one class only (or none) every score is that class's
rate (or 0.5); repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import prefix_sums, range_hash, spans, text_blocks, written
from mercata.llm.toxicity import learnable, lower, word_bytes

LABELLED, ROUNDS, PER_ROUND, SURE, RIDGE = 8_192, 5, 400, 0.9, 1.0
#: Byte classes of the text view; all other bytes are one more class.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".", b",", b"!", b"?", b"|",
           b"*#$%&", b"<>={}[]()/\\", b"@:;_-+'\"~^`", bytes(range(128, 256))]
SOURCES, LANGS, LAYOUT = 64, 16, 3


def _classes() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    for k, chars in enumerate(CLASSES):
        out[list(chars)] = k
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text features, layout features) of a block of texts."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    c = len(CLASSES) + 1
    share = np.bincount(doc * c + _classes()[data], minlength=n * c).reshape(n, c) / np.maximum(size, 1)[:, None]
    low = lower(data)
    sums = prefix_sums(low)
    start, end, wdoc = spans(data, offsets, word_bytes()[data])
    words = np.maximum(np.bincount(wdoc, minlength=n), 1)
    mean = np.bincount(wdoc, end - start, n) / words
    short = np.bincount(wdoc, (end - start) <= 2, n) / words
    kinds = _distinct(wdoc, range_hash(sums, start, end), n) / words
    lstart, lend, ldoc = spans(data, offsets, (data != 10) & (data != 13))
    lines = np.maximum(np.bincount(ldoc, minlength=n), 1)
    same = 1 - _distinct(ldoc, range_hash(sums, lstart, lend), n) / lines
    text = np.column_stack([share, np.log1p(mean), short, kinds, kinds * np.log(words + 1), same])
    layout = np.column_stack([np.log1p(size), np.log1p(lines), np.log1p(size / lines)])
    return text, layout


def features(batch) -> np.ndarray:
    """One row of numbers a document: text features, ``LAYOUT`` layout features, numbers of source and language."""
    rows = [np.hstack(text_view(data, off)) for _, _, data, off in text_blocks(batch.column("text"))]
    tags = [[zlib.crc32((v or "").encode()) % size for v in batch.column(name).to_pylist()] for name, size in (("source", SOURCES), ("lang", LANGS))]
    return np.column_stack([np.concatenate(rows), *tags]).astype(np.float32) if rows else np.zeros((0, len(CLASSES) + 8 + LAYOUT), np.float32)


def views(rows: np.ndarray) -> list[np.ndarray]:
    """[text view, metadata view] of rows of features."""
    rows = rows.astype(np.float64)
    text, layout, tags = rows[:, :-LAYOUT - 2], rows[:, -LAYOUT - 2:-2], rows[:, -2:].astype(np.int64)
    hot = np.hstack([np.eye(size)[tags[:, k]] for k, size in enumerate((SOURCES, LANGS))])
    return [np.hstack([text, text ** 2]), np.hstack([layout, layout ** 2, hot])]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views_l: list[np.ndarray], y: np.ndarray, surest: Callable) -> dict:
    """Model of two views from labelled rows and from the unlabelled rows they teach each other.

    ``surest(score, wanted)`` gives, for each view, {label: views of its surest rows} among those not given before:
    ``score`` makes the views of rows the probability of label 1 by each view, ``wanted`` is {label: rows at most}.
    """
    if len(y) == 0 or y.min() == y.max():
        return {"rate": 0.5 if len(y) == 0 else float(y[0])}
    mean, scale = [v.mean(axis=0) for v in views_l], [v.std(axis=0) + 1e-6 for v in views_l]
    views_l = [(v - m) / s for v, m, s in zip(views_l, mean, scale)]
    held = np.arange(len(y)) % 4 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    rate = y.mean()
    wanted = {1.0: int(np.ceil(PER_ROUND * rate)), 0.0: int(np.ceil(PER_ROUND * (1 - rate)))}
    taught = [(l[~held], y[~held]) for l in views_l]  # rows and labels that each view learns from

    def standard(rows):
        return [np.clip((v - m) / s, -20, 20) for v, m, s in zip(rows, mean, scale)]

    for k in range(ROUNDS + 1):
        weights = [logistic(*t) for t in taught]
        if k == ROUNDS:
            break

        def score(rows, weights=weights):
            return [1 / (1 + np.exp(-np.clip(margin(v, w), -30, 30))) for v, w in zip(standard(rows), weights)]

        for v, given in enumerate(surest(score, wanted)):
            for label, rows in given.items():
                x, t = taught[1 - v]
                taught[1 - v] = (np.vstack([x, standard(rows)[1 - v]]), np.append(t, np.full(len(rows[0]), label)))
    check = held if held.any() else np.ones(len(y), bool)
    logits = np.column_stack([margin(v[check], w) for v, w in zip(views_l, weights)])
    platt = [logistic(np.clip(m, -30, 30)[:, None], y[check], 1e-3) for m in logits.T]
    calibrated = np.column_stack([np.clip(m, -30, 30) * p[0] + p[1] for m, p in zip(logits.T, platt)])
    return {"mean": mean, "scale": scale, "weights": weights, "platt": platt, "both": logistic(calibrated, y[check], 1e-3),
            "taught": [len(t) - int((~held).sum()) for _, t in taught]}


def predict(model: dict, views_x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text score, metadata score, combined score)."""
    n = len(views_x[0])
    if "rate" in model:
        return tuple(np.full(n, model["rate"]) for _ in range(3))
    logit = [np.clip(margin(np.clip((v - m) / s, -20, 20), w), -30, 30) * p[0] + p[1]
             for v, m, s, w, p in zip(views_x, *(model[k] for k in ("mean", "scale", "weights", "platt")))]
    logit.append(margin(np.column_stack(logit), model["both"]))
    return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in logit)


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), len(CLASSES) + 8 + LAYOUT)


def _surest(pool: DataFrame, score: Callable, wanted: dict, most: int) -> pa.Table:
    """The ``most`` surest rows of each view and label: (view, label, sure, h, id, v)."""
    kind = pool.schema["id"].dataType.simpleString()

    def best(batches):
        kept = {}
        for b in batches:
            x, h = unpacked(b.column("v")), b.column("h").to_numpy()
            for view, p in enumerate(score(views(x))):
                for label in wanted:
                    sure = p if label else 1 - p
                    at = np.flatnonzero(sure >= SURE)
                    part = b.take(pa.array(at)).append_column("sure", pa.array(sure[at]))
                    if (view, label) in kept:
                        part = pa.Table.from_batches([kept[view, label], part]).combine_chunks().to_batches()
                        part = part[0] if part else b.slice(0, 0).append_column("sure", pa.array([], pa.float64()))
                    order = np.lexsort((part.column("h").to_numpy(), -part.column("sure").to_numpy()))[:most]
                    kept[view, label] = part.take(pa.array(order))
        for (view, label), part in kept.items():
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.int32()), pa.array([label] * n, pa.float64()), part.column("sure"), part.column("h"),
                                              part.column("id"), part.column("v")], names=["view", "label", "sure", "h", "id", "v"])

    found = pool.mapInArrow(best, f"view int, label double, sure double, h long, id {kind}, v binary").withColumn("deal", F.pmod("h", F.lit(64)))
    for by in (["view", "label", "deal"], ["view", "label"]):  # the rows of all tasks are cut down in two steps
        found = found.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "h", "id"))).where(F.col("r") <= most)
    return found.select("view", "label", "sure", "h", "id", "v").orderBy("view", F.desc("label"), F.desc("sure"), "h", "id").toArrow()


def pool_of(pool: DataFrame) -> Callable:
    """``surest`` of :func:`co_train` over all rows (id, h, v) of a table."""
    taken = set()

    def surest(score, wanted):
        # rows given before and those that the first view takes now may stand among the surest
        left = pool
        if taken:
            gone = pool.sparkSession.createDataFrame([(i,) for i in taken], pool.select("id").schema)
            left = pool.join(F.broadcast(gone), "id", "left_anti")  # at most 2 * PER_ROUND + 4 ids a round
        found = _surest(left, score, wanted, 2 * PER_ROUND + 2)
        view, label, ids = (found.column(c).to_pylist() for c in ("view", "label", "id"))
        x, out = unpacked(found.column("v")), []
        for v in (0, 1):
            out.append({})
            for wish, most in wanted.items():
                rows = [k for k in range(len(ids)) if (view[k], label[k]) == (v, wish) and ids[k] not in taken][:most]
                taken.update(ids[k] for k in rows)
                out[v][wish] = views(x[rows])
        return out

    return surest


def fit(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> dict:
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in features(b)], pa.binary())], names=["id", "v"])

    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col(label_col).isin(0, 1), F.col(label_col))).cast("double").alias("label"), F.lit(True).alias("seen"))
    rows = docs.where(learnable(id_col)).withColumnRenamed(id_col, "id").mapInArrow(packed, f"id {kind}, v binary")
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")).join(known, "id", "left")
                   .where("label IS NOT NULL OR seen IS NULL").select("id", F.xxhash64("id").alias("h"), "v", "label"), "quality")
    data = rows.where("label IS NOT NULL").orderBy("h", "id").limit(LABELLED).select("v", "label").toArrow()
    return co_train(views(unpacked(data.column("v"))), data.column("label").to_numpy(), pool_of(rows.where("label IS NULL").drop("label")))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, text_score, meta_score, score, predicted) for every row of docs."""
    columns = [F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang")]
    src = docs.select(id_col, *columns)
    model = fit(src, labels, id_col, label_col)
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            scores = predict(model, views(features(b)))
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(s) for s in scores)], names=[id_col, "text_score", "meta_score", "score"])

    scored = src.mapInArrow(run, f"{id_col} {kind}, text_score double, meta_score double, score double")
    return scored.select(id_col, (~F.coalesce(learnable(id_col), F.lit(False))).alias("held_out"), "text_score", "meta_score", "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
