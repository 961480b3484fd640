"""Language identification as inference of a multilingual mixture.

Each learned language is a model of byte trigrams inside words (word ends included, hashed to ``BUCKETS``
numbers, additive smoothing).  A document is a mixture: each word comes from language l with probability
share(l), and has that language's trigram likelihood.  Expectation-maximisation estimates the shares.
The language set is chosen by penalised likelihood among the nested sets of the largest shares: the
re-estimated log likelihood less ``PENALTY`` times half the log of the word count for each language.

The trigram models are counted on a bounded sample of the rows outside the held-out fold, about
``TRAIN_ROWS`` rows a language, chosen by the hash of the id at a rate computed from the counts of all
rows; at most ``LANGUAGES`` languages are learned, those of most rows (ties: smaller name), so a dirty tag column
cannot grow the model: what is collected is bounded by ``LANGUAGES`` times ``BUCKETS``.  Inference reads every whole text
once, in vectorised blocks, without a shuffle.

Defined cases: a null text or one without any letter is ``und`` with score 0; a text whose letters no model
knows gets the language with the most sampled text; without a learned language every row is ``und``;
repeated rows each give a row; rows with null lang are predicted but not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.llm.common import spans, text_blocks
from mercata.llm.toxicity import learnable, lower

TRAIN_ROWS, LANGUAGES, BUCKETS, SMOOTHING = 2_000, 128, 1 << 17, 0.1
ROUNDS, SET_ROUNDS, PENALTY, LEAST_SHARE = 10, 2, 4.0, 0.01


def letters() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
    inside[128:] = True
    return inside


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """Words as (start, end, text number) and, for every byte of the text, the hashed trigram around it."""
    inside = letters()[data]
    start, end, doc = spans(data, offsets, inside)
    clean = np.zeros(len(data) + 2, np.uint32)
    clean[1:-1] = np.where(inside, lower(data), 0)
    gram = (clean[:-2] << np.uint32(16)) | (clean[1:-1] << np.uint32(8)) | clean[2:]
    # the text before or after is no context
    gram[offsets[:-1][offsets[:-1] < len(data)]] &= np.uint32(0x00FFFF)
    last = offsets[1:] - 1
    gram[last[last >= 0]] &= np.uint32(0xFFFF00)
    return start, end, doc, inside, ((gram * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int32)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for i, j, data, off in text_blocks(b.column("text")):
            _, _, _, inside, gram = trigrams(data, off)
            for r in range(i, j):
                part = slice(off[r - i], off[r - i + 1])
                counts.setdefault(langs[r], np.zeros(BUCKETS, np.int64))
                counts[langs[r]] += np.bincount(gram[part][inside[part]], minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                         names=["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each trigram in each)."""
    rows = docs.where(F.col(lang_col).isNotNull() & learnable(id_col))
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col(lang_col) == r["lang"], F.lit(min(1.0, TRAIN_ROWS / r["count"]))).otherwise(rate)
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < rate * (1 << 30)
    counts = (rows.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
              .mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    order = counts.groupby("lang")["n"].sum().sort_index().sort_values(ascending=False, kind="stable").index.tolist()
    table = np.full((len(order), BUCKETS), SMOOTHING)
    for k, lang in enumerate(order):
        part = counts[counts.lang == lang]
        table[k, part["gram"].to_numpy()] += part["n"].to_numpy()
    return order, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(p: np.ndarray, share: np.ndarray, size: np.ndarray, cut: np.ndarray, rounds: int):
    """Shares (languages x texts) after some rounds, and the log likelihood (less the words' maxima)."""
    for _ in range(rounds):
        r = p * np.repeat(share, size, axis=1)
        r /= np.maximum(r.sum(axis=0), 1e-30)
        share = np.add.reduceat(r, cut, axis=1) / size
    mixed = np.log(np.maximum((p * np.repeat(share, size, axis=1)).sum(axis=0), 1e-30))
    return share, np.add.reduceat(mixed, cut)


def mixtures(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Chosen shares (texts x languages); a row of zeros for a text without a word."""
    n, out = len(table), np.zeros((len(offsets) - 1, len(table)), np.float32)
    start, end, doc, _, gram = trigrams(data, offsets)
    if not len(start) or not n:
        return out
    edges = np.stack([start, end], 1).ravel()
    edges = edges[:-1] if edges[-1] == len(data) else edges
    like = np.stack([np.add.reduceat(t[gram], edges)[::2] for t in table])
    like = np.exp(np.maximum(like - like.max(axis=0), -60))
    texts, cut, size = np.unique(doc, return_index=True, return_counts=True)
    share, _ = _em(like, np.full((n, len(texts)), 1 / n, np.float32), size, cut, ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    best, gain = None, None
    for k in range(1, n + 1):
        if k > 1 and not np.any((share >= LEAST_SHARE) & (rank == k - 1)):
            break
        part = np.where(rank < k, np.maximum(share, 1e-6), 0)
        part, ll = _em(like, (part / part.sum(axis=0)).astype(np.float32), size, cut, SET_ROUNDS if k > 1 else 0)
        ll = ll - PENALTY * (k - 1) * 0.5 * np.log(size + 1)
        if best is None:
            best, gain = part, ll
        else:
            better = ll > gain
            best, gain = np.where(better, part, best), np.maximum(ll, gain)
    out[texts] = best.T
    return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = letters()
    ascii_letter[128:] = False
    seen = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for r in np.flatnonzero(~out):
        raw = data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
        out[r] = any(c.isalpha() for c in raw)
    return out


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, languages): one row per row of docs; ``languages`` holds the
    chosen set with its shares, largest first; score is the share of lang_pred."""
    names, table = fit(docs, id_col, text_col, lang_col)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for b in batches:
            pred, score, sets = [], [], []
            for i, j, data, off in text_blocks(b.column("text")):
                share = mixtures(data, off, table)
                known = _has_letter(data, off) & bool(names)
                order = np.argsort(-share, axis=1, kind="stable")
                for r in range(j - i):
                    if not known[r]:
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    top = [k for k in order[r] if share[r, k] > 0]
                    pred.append(names[top[0]] if top else names[0])
                    score.append(min(1.0, float(share[r, top[0]])) if top else 0.0)
                    sets.append([{"lang": names[k], "share": float(share[r, k])} for k in top])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)],
                names=["id", "lang_pred", "score", "languages"])

    schema = f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, " \
        "languages array<struct<lang:string,share:double>>"
    return src.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), (~F.coalesce(learnable("id"), F.lit(False))).alias("held_out"), "lang_pred", "score", "languages")
