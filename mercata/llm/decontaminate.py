"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (lower case, every run of characters that are no letters,
digits or marks is one space).  An item of m characters may occur with e = floor(``RATE`` * m) edits; such an
occurrence shares at least m + 1 - q - q * e of the item's q-grams with the text, all on diagonals
(text position - item position) that differ by at most e.  So:

* q-gram hits are counted per item in overlapping diagonal bands of width 2w, w > e, at every
  multiple of w: any e + 1 neighbouring diagonals lie in one band;
* bands that reach the bound are retained, touching bands of an item merged;
* each retained region is verified by banded alignment of the whole item against the region (free
  ends in the text), within its diagonals; at most e edits make a match.

Documents are read once and never shuffled; the benchmark travels to the tasks in blocks of at most
``ITEM_BLOCK`` characters, each block a pass over the documents, so nothing of unproven size is broadcast.

Defined cases: null or empty texts match nothing; items under q normalised characters (or null) are no
evidence and are not searched; items so short that the bound would be below 1 get a smaller budget; equal
items each match; a document gives one row per item and place; an empty benchmark gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.llm.common import mix, text_blocks

Q, RATE = 8, 0.1
ITEM_BLOCK, ITEM_CHUNK = 4_000_000, 512
_P = 0x9E3779B97F4A7C15
_TABLE: dict[str, np.ndarray] = {}


def _folds() -> np.ndarray:
    """Per code point of planes 0 and 1: 0 for a separator, else its lower case.  Letters, numbers and marks of
    any script are no separators."""
    if "fold" not in _TABLE:
        fold = np.zeros(0x20000, np.uint32)
        for c in range(len(fold)):
            char = chr(c)
            if char.isalnum() or unicodedata.category(char)[0] == "M":
                low = char.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _TABLE["fold"] = fold
    return _TABLE["fold"]


def normalise(data: np.ndarray, offsets: np.ndarray):
    """(characters, their places in the text, offsets) of the normalised texts."""
    first = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(first)))[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(chars) != at[-1]:  # not valid UTF-8: every byte is a character
        chars, at = data.astype(np.uint32), offsets
    fold = _folds()
    # planes 2 and 3 hold ideographs, all letters; nothing above them is text
    low = np.where(chars < len(fold), fold[np.minimum(chars, len(fold) - 1)], np.where(chars < 0x40000, chars, 0))
    word = low > 0
    keep = word.copy()
    keep[1:] |= word[:-1] & ~word[1:]
    starts = at[:-1][at[:-1] < len(chars)]
    keep[starts] = word[starts]
    kept = np.concatenate(([0], np.cumsum(keep)))
    out = low[keep]
    out[out == 0] = 32
    where = np.flatnonzero(keep)
    return out, where - np.repeat(at[:-1], np.diff(kept[at])), kept[at]


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position on (q a power of two), by doubling."""
    h, size = chars.astype(np.uint64) + np.uint64(1), 1
    while size < q:
        h = h[:-size] * _pow(size) + h[size:]
        size *= 2
    return mix(h)


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


class Items:
    """The q-gram index of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], q: int, rate: float):
        self.ids, self.chars, self.budget, bound = [], [], [], []
        for k, t in zip(ids, texts):
            raw = np.frombuffer(t.encode("utf-8"), np.uint8)
            c, _, _ = normalise(raw, np.array([0, len(raw)]))
            c = c[:-1] if len(c) and c[-1] == 32 else c
            m = len(c)
            if m < q:
                continue
            e = min(int(rate * m), (m - q) // q)
            self.ids.append(k)
            self.chars.append(c)
            self.budget.append(e)
            bound.append(m + 1 - q - q * e)
        self.bound = np.array(bound, np.int64)
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.shift = np.array([max(3, int(e).bit_length()) for e in self.budget], np.int64)
        keys = [grams(c, q) for c in self.chars]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.first = np.unique(key[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(key)))
        self.item, self.place = item[order], place[order]

    def maybe(self) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[self.key >> np.uint64(44)] = True
        return seen


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits between the whole item and any part of the text, on diagonals low to high
    (text position - item position): (edits, start, end) of the leftmost best."""
    width, m, n = high - low + 1, len(item), len(text)
    raw, part = text.tobytes(), item.tobytes()
    at = raw.find(part)
    while at >= 0:  # no edit: the diagonal itself is the alignment
        if at % 4 == 0 and low <= at // 4 <= high:
            return 0, at // 4, at // 4 + m
        at = raw.find(part, at + 1)
    far, one = np.int64(1 << 50), np.int64(1 << 32)
    # a cell holds edits * 2**32 + start; cell x of row i is text position i + low + x
    pos = np.arange(width, dtype=np.int64) + low
    row = np.where((pos >= 0) & (pos <= n), np.clip(pos, 0, n), far)
    steps = np.arange(width, dtype=np.int64) * one
    padded = np.full(n + 2 * width + m + 2, -1, np.int64)
    shift = width + max(0, -low) + 1
    if shift + n > len(padded):
        padded = np.full(shift + n + width + m + 2, -1, np.int64)
    padded[shift:shift + n] = text
    up = np.full(width, far)
    for i in range(m):
        pos = pos + 1  # text positions after row i + 1
        lo = i + low + shift
        here = padded[max(lo, 0):lo + width]
        diag = row + np.where(here == item[i], 0, one)
        up[:-1] = row[1:]  # the item's character is missing in the text
        cur = np.minimum(diag, up + one)
        cur = np.minimum.accumulate(cur - steps) + steps  # text characters that the item lacks
        row = np.where((pos >= 0) & (pos <= n), np.minimum(cur, far), far)
    x = int(np.argmin(row))
    return int(row[x] >> 32), int(row[x] & 0xFFFFFFFF), int(pos[x])


def regions(chars: np.ndarray, offsets: np.ndarray, key: np.ndarray, valid: np.ndarray, items: Items, maybe: np.ndarray):
    """Retained (item, lowest diagonal, highest diagonal) of a block of texts."""
    if not len(items.ids) or not len(key):
        return
    at = np.flatnonzero(maybe[key >> np.uint64(44)] & valid)
    k = np.searchsorted(items.key, key[at])
    k[k == len(items.key)] = 0
    real = items.key[k] == key[at]
    at, k = at[real], k[real]
    n = items.count[k]
    pick = np.repeat(items.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item = items.item[pick]
    diagonal = np.repeat(at, n) - items.place[pick] + items.size[item]  # never negative
    bands = ((len(chars) + 2 * items.size) >> items.shift) + 3
    base = np.concatenate(([0], np.cumsum(bands)))
    band = base[item] + (diagonal >> items.shift[item]) + 1
    # only bands that are hit are counted, so memory follows the hits and not items x text length
    hit, hits = np.unique(np.concatenate([band, band - 1]), return_counts=True)
    owner = np.searchsorted(base, hit, "right") - 1
    full = hits >= items.bound[owner]
    hit, owner = hit[full], owner[full]
    if not len(hit):
        return
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(owner) > 0)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(hit)]):
        i = owner[lo]
        w, d = 1 << items.shift[i], base[i] + 1
        yield i, int((hit[lo] - d) * w - items.size[i]), int((hit[hi - 1] - d + 2) * w - 1 - items.size[i])


def occurrences(column: pa.Array, blocks: list[Items], maybes: list[np.ndarray], q: int) -> list[tuple]:
    """(row, item id, edits, start, end) of every match in a column of texts."""
    rows = []
    for i, j, data, off in text_blocks(column):
        chars, where, at = normalise(data, off)
        if len(chars) < q:
            continue
        key = grams(chars, q)
        valid = np.ones(len(chars), bool)
        ends = (at[1:, None] - np.arange(1, q)).ravel()
        valid[ends[(ends >= np.repeat(at[:-1], q - 1))]] = False
        valid = valid[:len(key)]
        for items, maybe in zip(blocks, maybes):
            for it, low, high in regions(chars, at, key, valid, items, maybe):
                m, e = int(items.size[it]), items.budget[it]
                for d in range(max(0, int(np.searchsorted(at, max(low, 0), "right")) - 1), j - i):
                    if at[d] > high + m + e:
                        break
                    s, t = max(int(at[d]), low), min(int(at[d + 1]), high + m + e)
                    if t - s < m - e:
                        continue
                    edits, x, y = align(items.chars[it], chars[s:t], low - s - e, high - s + e)
                    if edits <= e and y > x:
                        rows.append((i + d, items.ids[it], edits, int(where[s + x]), int(where[s + y - 1]) + 1))
    return rows


def _search(blocks: list[Items], q: int):
    def run(batches):
        maybes = [x.maybe() for x in blocks]
        for b in batches:
            rows = occurrences(b.column("text"), blocks, maybes, q)
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["id", "item_id", "edits", "start", "end"])
    return run


def _clean(blocks: list[Items], q: int, text_col: str):
    def run(batches):
        maybes = [x.maybe() for x in blocks]
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in occurrences(b.column(text_col), blocks, maybes, q)]] = False
            yield b.filter(pa.array(keep))
    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, q: int, rate: float):
    """The benchmark as lists of q-gram indexes, each list of at most ITEM_BLOCK characters and one text."""
    wanted = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col))
    block, size = [], 0
    for item, text in wanted.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= ITEM_BLOCK:
            yield _indexes(block, q, rate)
            block, size = [], 0
    if block:
        yield _indexes(block, q, rate)


def _indexes(block, q, rate):
    return [Items([k for k, _ in block[i:i + ITEM_CHUNK]], [t for _, t in block[i:i + ITEM_CHUNK]], q, rate)
            for i in range(0, len(block), ITEM_CHUNK)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """(id_col, item_id, edits, start, end): every place where an item occurs within its budget;
    start and end are code point positions in the original text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, item_id long, edits int, start long, end long"
    passes = [src.mapInArrow(_search(block, q), schema) for block in item_blocks(benchmark, item_col, item_text_col, q, rate)]
    found = passes[0] if passes else docs.sparkSession.createDataFrame([], schema)
    for p in passes[1:]:
        found = found.union(p)
    return found.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no benchmark item, decided where they are read; all columns."""
    for block in item_blocks(benchmark, item_col, item_text_col, q, rate):
        docs = docs.mapInArrow(_clean(block, q, text_col), docs.schema)
    return docs
