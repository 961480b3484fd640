"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit SimHash of its word shingles.  Fingerprints at ``max_bits`` (4) or fewer
differing bits are linked, exactly, through a covering code:

* The anchors are the words of a product code on bits 0-45: two copies of the perfect binary
  Golay code (23 bits, 12 information bits, covering radius 3).  2**24 anchors; each half of any
  46-bit word has exactly one codeword within 3 bits.
* Two fingerprints at d <= 4 bits have a midpoint at 2 bits or fewer from both, and the midpoint has
  an anchor at covering radius 3 in either half.  So both lie within the covering radius plus
  half of the threshold of that common anchor, and replicating each fingerprint to all anchors with
  (excess over 3 in half one) + (excess in half two) <= 2 loses no link.  That is about 61 anchors a
  fingerprint, a fixed number whatever the input; the full threshold around one side only would
  take 1,235.
* Fingerprints meet per anchor, sorted and streamed; all 64 bits are compared.  An anchor emits a
  spanning forest of its links, not all its pairs, so a group of n near copies makes n - 1 rows;
  an anchor with more than ``HOT`` fingerprints is dealt out as pairs of chunks.

Equal fingerprints are one class before anything is replicated, so exact copies cost nothing.

Defined cases: null text counts as empty; an empty text (or one with no word) has fingerprint zero
and links like any other; a text with fewer words than a shingle has one shingle, all its words;
repeated rows each give a row; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint, connected_components, text_blocks

#: Words in a shingle, seed of XXH64, most differing bits of a link.
SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: An anchor with more fingerprints is compared as pairs of chunks of this size.
HOT = 4096
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text's bytes."""
    parts = text.translate(_UPPER).split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = list(accumulate(map(len, parts)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts, ends[min(words, len(parts)) - 1:])])
    n, at = len(hashes) // 8, np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        count += np.unpackbits(at[i:i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = src.drop("text").schema.add("fp", "long")

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, j, data, off in text_blocks(b.column("text")):
                raw = data.tobytes()
                for r in range(i, j):
                    out[r] = fingerprint(raw[off[r - i]:off[r - i + 1]], words)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, schema)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    x = x.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> np.uint32(bit)) & np.uint32(1), np.uint32(GOLAY << (bit - 11)), np.uint32(0))
    return x


def covering_table(slack: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each syndrome, the error patterns that lead to a codeword, and their excess over radius 3."""
    errors = np.array([sum(1 << b for b in c) for w in range(3 + slack + 1) for c in combinations(range(23), w)],
                      np.uint32)
    weight = np.array([bin(e).count("1") for e in errors])
    syn = _syndrome(errors)
    order = np.argsort(syn, kind="stable")
    cut = np.searchsorted(syn[order], np.arange(2049))
    excess = np.maximum(weight - 3, 0)
    return [(errors[order[cut[s]:cut[s + 1]]], excess[order[cut[s]:cut[s + 1]]]) for s in range(2048)]


def anchors(fp: np.ndarray, table, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row number, anchor) for every anchor near enough to each fingerprint (uint64)."""
    low = (fp & np.uint64(0x7FFFFF)).astype(np.uint32)
    high = ((fp >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.uint32)
    s1, s2 = _syndrome(low), _syndrome(high)
    rows, out = [], []
    for r in range(len(fp)):
        (e1, x1), (e2, x2) = table[s1[r]], table[s2[r]]
        i, j = np.nonzero(x1[:, None] + x2[None, :] <= slack)
        out.append((low[r] ^ e1[i]).astype(np.int64) | ((high[r] ^ e2[j]).astype(np.int64) << 23))
        rows.append(np.full(len(i), r))
    return np.concatenate(rows), np.concatenate(out)


def _replicate(slack: int):
    def run(batches):
        table = covering_table(slack)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                rows, at = anchors(part.view(np.uint64), table, slack)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[rows])], names=["anchor", "fp"])
    return run


def spanning_links(fp: np.ndarray, max_bits: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the pairs within ``max_bits`` connect; block by block, n - 1 at most."""
    n = len(fp)
    if n == 2:
        return [(fp[0], fp[1])] if bin(int(fp[0]) ^ int(fp[1])).count("1") <= max_bits else []
    parent, out = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, n, 256):
        near = np.bitwise_count(fp[i:i + 256, None] ^ fp[None, i:]) <= max_bits
        for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(near, 1)))):
            rx, ry = root(i + x), root(i + y)
            if rx != ry:
                parent[ry] = rx
                out.append((fp[i + x], fp[i + y]))
    return out


def _compare(max_bits: int):
    """Sorted (anchor, chunk, fp) rows -> links; a run that goes on in the next batch is carried over."""
    def links(anchor, chunk, fp):
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        cut = np.concatenate(([0], cut, [len(anchor)]))
        size = np.diff(cut)
        a, b = [], []
        two = cut[:-1][size == 2]
        ok = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        a.append(fp[two[ok]])
        b.append(fp[two[ok] + 1])
        for k in np.flatnonzero(size > 2):
            if found := spanning_links(fp[cut[k]:cut[k + 1]], max_bits):
                x, y = zip(*found)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        keep = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)]
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "chunk", "fp")]
            new[2] = new[2].view(np.uint64)
            at = [np.concatenate(x) for x in zip(keep, new)]
            last = np.flatnonzero((at[0] != at[0][-1]) | (at[1] != at[1][-1])) if len(at[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(*(x[:cut] for x in at))
            keep = [x[cut:] for x in at]
        if len(keep[0]) > 1:
            yield links(*keep)
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that connect all pairs within max_bits; of an odd
    distance the midpoint is half a bit further from one of the two."""
    near = distinct.mapInArrow(_replicate((max_bits + 1) // 2), "anchor long, fp long")
    hot = near.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = checkpoint(hot)
    if hot.isEmpty():
        dealt = near.withColumn("chunk", F.lit(0))
    else:
        k = F.ceil(F.col("n") / (HOT // 2)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), k).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), k - 1),
                            lambda j: (F.least(mine, j) * k + F.greatest(mine, j)).cast("int"))
        dealt = near.join(hot, "anchor", "left").select(
            "anchor", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("chunk"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("anchor", "chunk", "fp").repartition(parts, "anchor", "chunk").sortWithinPartitions("anchor", "chunk")
    return dealt.mapInArrow(_compare(max_bits), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per input row; component_id is the smallest id
    reachable over links of ``max_bits`` or fewer differing bits."""
    prints = checkpoint(fingerprints(docs, id_col, text_col, words))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    links = fingerprint_links(classes.select("fp"), max_bits)
    comp = connected_components(links, "a", "b")
    joined = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    joined = checkpoint(joined)
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    members = joined.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return prints.join(members, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component, the one with the smallest (id, hash of the text); all columns."""
    src = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("k"),
                      F.col(text_col).alias("text"))
    found = simhash_components(src, "k", "text", words, max_bits)
    keep = found.where(F.col("k").eqNullSafe(F.col("component_id"))).select(F.col("k")["i"].alias("i"), F.col("k")["h"].alias("h")).distinct()
    kept = src.select("row", F.col("k")["i"].alias("ki"), F.col("k")["h"].alias("kh"))
    kept = kept.join(keep, kept["ki"].eqNullSafe(keep["i"]) & (kept["kh"] == keep["h"]))
    return kept.dropDuplicates(["ki", "kh"]).select("row.*")
