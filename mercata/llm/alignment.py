"""Cross-tokenizer alignment: the tokens of one text under two tokenizers, cut into the smallest groups that
span the same bytes, and linked where their bytes overlap.

The texts are the space in front plus the text, as a byte-level BPE file (A) and a SentencePiece model (B) see it.

* Per stretch of text, the cumulative byte ends of either side become a dictionary from end to token number; the
  intersection of the two key sets, sorted, slices both id lists into groups, and the links are expanded per slice:
  all pairs if one side of the slice is a single token, else the overlapping pairs in one walk.
* Stretches: a text is cut at places that no token of either tokenizer can cross (before a space that follows no white
  space, between a Latin letter and ASCII punctuation, after a single line end; checked for the pieces of B and by the
  kind of A when the files are loaded, otherwise the text is one stretch).  Such a cut is an end of both, so a task
  encodes and slices every distinct stretch once, many in a row at a time (``MEMO`` stretches, then it starts over).
* ``aligned`` gives the groups of every text and how often each id pair is linked in it, ``link_counts`` sums the pairs
  over all rows, and ``with_counts`` brings the counts back: the ``TABLE`` most frequent pairs, a table of bounded size,
  are summed where the rows are read, links of other pairs are joined to all counts.  No text is shuffled.

Defined cases: texts that are null or empty, or that the tokens of either side do not give back byte by byte (U+2581
in a text is read as a space by B), have no tokens: zeros and an empty ``groups``.  Rows are kept one to one, repeated
and null ids included; an empty table gives none.  Only the named columns are read.
A text is held in portions of ``PORTION`` characters; only a stretch without a cut is held as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.llm.common import checkpoint, small_batches

MEMO, TABLE, PORTION, HELD, BLOCK = 1 << 19, 1 << 20, 1 << 20, 1 << 18, 1 << 13
#: Letters of Latin-1, ASCII characters that are no letters (and no space), such punctuation that starts no contraction.
_L, _ASCII, _PUNCT = "A-Za-zÀ-ÖØ-öø-ÿ", r"\n!-@\[-`{-~", r"!-&(-/:-@\[-`{-~"
#: Characters after which a space starts no stretch; beyond white space two that older regex libraries count as such.
_WHITE = r"\s᠎﻿"
CUT = rf"(?:(?<=[^{_WHITE}])(?= )|(?<=[{_L}])(?=[{_ASCII}])|(?<=[{_PUNCT}])(?=[{_L}])|(?<=[^{_WHITE}]\n)(?=[{_L}]))"
STRETCH = rf" ?[{_L}]++(?=[ {_ASCII}]|\Z)|(?s:.+?)(?:{CUT}|\Z)"
#: The pre-tokenization that the ByteLevel type stands for (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters stand for
    themselves, the others for the letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers, made from the contents of their files."""

    def __init__(self, a_file: str, b_file: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        spec, letters = json.loads(a_file), byte_letters()
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes([letters[c] for c in token]) if all(c in letters for c in token) else token.encode()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(b_file)
        rules, cutter = proto.normalizer_spec, spec.get("pre_tokenizer") or {}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_bytes = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        cut, pieces = re.compile(CUT), [self.b.id_to_piece(i).replace("▁", " ") for i in range(len(self.b)) if self.b.is_byte(i) is False and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.separable = (
            not spec.get("normalizer") and cutter.get("type") == "ByteLevel" and bool(cutter.get("use_regex", True))
            and not cutter.get("add_prefix_space") and not rules.precompiled_charsmap and rules.add_dummy_prefix
            and not rules.remove_extra_whitespaces and not any("\n" in p or any(0 < m.start() < len(p) for m in cut.finditer(p)) for p in pieces))
        self.latin = None
        if self.separable:
            rules.add_dummy_prefix = False  # every text begins with its space
            self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
            merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
            if [vocab[m] for m in merges] == list(range(256, 256 + len(merges))) and len(set(vocab.values()) - set(range(256 + len(merges)))) <= 1:
                import tiktoken

                # merges in the order of the ids: the ranks of the faster library, which is used for Latin letters
                ranks = {r: i for i, r in enumerate(self.a_bytes[:256 + len(merges)])}
                self.latin = tiktoken.Encoding("latin", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # every id as text, followed by a comma or by the end of its side of a group
        self.text = [f"{i}{e}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for e in ends]

    def stretches(self, text: str) -> Iterable[list[str]]:
        """The stretches of the space plus the text, portion by portion."""
        whole = " " + text
        if not self.separable:
            yield [whole]
            return
        find, cut, at = re.compile(STRETCH).findall, re.compile(CUT), 0
        while len(whole) - at > PORTION and (m := cut.search(whole, at + PORTION)):
            yield find(whole[at:m.start()])
            at = m.start()
        yield find(whole[at:])

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of stretches under A and B."""
        if self.latin:
            fast, a = self.latin._core_bpe.encode_ordinary, [None] * len(stretches)
            other = []
            for k, s in enumerate(stretches):
                if s.isascii() or max(s) < "ɐ":
                    a[k] = fast(s)
                else:
                    other.append(k)
            for k, e in zip(other, self.a.encode_batch([stretches[k] for k in other], add_special_tokens=False)):
                a[k] = e.ids
        else:
            a = [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        return a, self.b.encode(stretches if self.separable else [s[1:] for s in stretches], num_threads=1)

    def gives_back(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw


def slices(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets at which tokens of both end, token counts of A up to each, token counts of B)."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(x, np.int64) for x in (common, [at_a[e] for e in common], [at_b[e] for e in common]))


def links(ends_a: list[int], ends_b: list[int], to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each slice, A token, B token of every link): all overlapping tokens, slice by slice.

    A slice with x and y tokens has x + y - 1 links, as no end inside it is shared: with one token on a side
    all pairs, else those met in one walk."""
    from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
    many_a, many_b = to_a - from_a > 1, to_b - from_b > 1
    n = (to_a - from_a) + (to_b - from_b) - 1
    last = np.cumsum(n)
    k = np.arange(last[-1] if len(n) else 0) - np.repeat(last - n, n)
    a = np.repeat(from_a, n) + k * np.repeat(many_a, n)
    b = np.repeat(from_b, n) + k * np.repeat(many_b, n)
    for g in np.flatnonzero(many_a & many_b).tolist():
        p, q, walk = int(from_a[g]), int(from_b[g]), []
        while p < to_a[g] and q < to_b[g]:
            walk.append((p, q))
            first = ends_a[p] - ends_b[q]
            p, q = p + (first <= 0), q + (first >= 0)
        a[last[g] - n[g]:last[g]], b[last[g] - n[g]:last[g]] = zip(*walk)
    return n, a, b


def shown(text: list[str], a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, a_ids: int) -> list[str]:
    """Per token, in the order of the groups, the pieces of ``a1,a2|b1;a3|b2,b3;``."""
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    out = np.empty(len(a) + len(b), np.int64)
    at = np.arange(len(a)) + np.repeat(to_b - size_b, size_a)
    out[at] = 2 * a
    out[at[to_a - 1]] += 1
    at = np.arange(len(b)) + np.repeat(to_a, size_b)
    out[at] = 2 * (b + a_ids)
    out[at[to_b - 1]] += 1
    return list(map(text.__getitem__, out.tolist()))


class Memo:
    """Numbered distinct stretches with their groups and the codes (A id * 2**32 + B id) of their links."""

    def __init__(self, encoders: Encoders):
        self.encoders, self.number, self.groups = encoders, {}, []
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 if the bytes differ
        self.codes, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, stretches: list[str]) -> None:
        found, codes = [self.sizes], [self.codes]
        for k in range(0, len(stretches), BLOCK):
            part = stretches[k:k + BLOCK]
            self.number.update(zip(part, count(len(self.groups))))
            size, code = self._block(part)
            found.append(size)
            codes.append(code)
        self.sizes, self.codes = np.concatenate(found), np.concatenate(codes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes[:, 3])))

    def _block(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slices of many stretches at once: they stand in a row, and every stretch ends both sides."""
        e = self.encoders
        a, b = e.encode(part)
        bad = np.zeros(len(part), bool)
        raw = "".join(part).encode()
        if any(b"".join([of[i] for i in chain.from_iterable(x)]) != raw for x, of in ((a, e.a_bytes), (b, e.b_bytes))):
            bad = np.array([not e.gives_back(s, x, y) for s, x, y in zip(part, a, b)], bool)
            for k in np.flatnonzero(bad).tolist():
                a[k], b[k] = [], []
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b])
        stop = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        assert np.array_equal(stop, np.concatenate(([0], ends_b))[np.cumsum(n_b)])
        ends_a, ends_b = ends_a.tolist(), ends_b.tolist()
        common, to_a, to_b = slices(ends_a, ends_b)
        until = np.searchsorted(common, stop, "right")  # slices up to the end of each stretch
        n, x, y = links(ends_a, ends_b, to_a, to_b)
        n_links = np.diff(np.concatenate(([0], np.cumsum(n)))[until], prepend=0)
        pieces, at = shown(e.text, a, b, to_a, to_b, len(e.a_bytes)), np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(pieces[i:j]) for i, j in zip([0, *at], at)]
        return np.stack((n_a, n_b, np.diff(until, prepend=0), n_links, bad), axis=1).astype(np.int64), (a[x] << 32) + b[y]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Stretch numbers of the texts in a row, and where each text ends in them (from 0)."""
        found, held, ends = [], [], [0]

        def settle():
            at = np.fromiter(map(self.number.get, held, repeat(-1)), np.int64, len(held))
            new = np.flatnonzero(at < 0)
            if len(new):
                new = new.tolist()
                self.add(list(dict.fromkeys([held[i] for i in new])))
                at[new] = [self.number[held[i]] for i in new]
            found.append(at)
            held.clear()

        done = 0
        for text in texts:
            for part in self.encoders.stretches(text) if text else ():
                held += part
                if len(held) > HELD:
                    done += len(held)
                    settle()
            ends.append(done + len(held))
        settle()
        return np.concatenate(found), np.array(ends, np.int64)

    def per_text(self, values: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums over each text of a value (or row of values) of its stretches."""
        sums = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values[at], axis=0)))
        return sums[ends[1:]] - sums[ends[:-1]]


def read_files(a_path: str, b_path: str) -> tuple[str, bytes]:
    """Contents of the tokenizer files, read on the driver; tasks get them as a broadcast."""
    return open(a_path, encoding="utf-8").read(), open(b_path, "rb").read()


def aligned(docs: DataFrame, files: tuple[str, bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of docs (all but the text if None) plus n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``) and the linked id pairs of the text: ``code`` in order and ``times``, the links of each.  Lazy."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    new = ["n_a", "n_b", "n_groups", "n_links"]
    if set(keep) & {*new, "groups", "code", "times"}:
        raise ValueError("rename columns that clash with the result")
    shared = docs.sparkSession.sparkContext.broadcast(files)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in new), T.StructField("groups", T.StringType()),
                           T.StructField("code", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches):
        encoders = Encoders(*shared.value)
        memo = Memo(encoders)
        for b in small_batches(batches, 256):
            at, ends = memo.numbers(b.column(text_col).to_pylist())
            sizes = memo.per_text(memo.sizes, at, ends)
            good = sizes[:, 4] == 0
            sizes[~good] = 0
            groups, pairs, of = [], [], memo.groups.__getitem__
            for k, ok in enumerate(good.tolist()):
                here = at[ends[k]:ends[k + 1]] if ok else at[:0]
                groups.append("".join(map(of, here.tolist()))[:-1])
                here, often = np.unique(here, return_counts=True)
                n = memo.sizes[here, 3]
                stop = np.cumsum(n)
                code = memo.codes[np.arange(n.sum()) + np.repeat(memo.first[here] - stop + n, n)]
                code, back = np.unique(code, return_inverse=True)
                pairs.append((code, np.bincount(back, weights=np.repeat(often, n), minlength=len(code)).astype(np.int64)))
            stops = np.concatenate(([0], np.cumsum([len(x) for x, _ in pairs]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([p[k] for p in pairs]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(sizes[:, k]) for k in range(4)),
                                              pa.array(groups, pa.string()), *lists], names=schema.names)
            if len(memo.groups) > MEMO:
                memo = Memo(encoders)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def link_counts(rows: DataFrame) -> DataFrame:
    """(code, n, best) of rows of ``aligned``: links of every linked id pair over all texts (code: A id * 2**32 + B id),
    and whether no other A id has more links with this B id.  Checkpointed."""
    n = rows.select(F.explode(F.arrays_zip("code", "times")).alias("x")).groupBy(F.col("x.code").alias("code")).agg(F.sum("x.times").alias("n"))
    n = checkpoint(n)
    b = F.col("code") % (1 << 32)
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most one row an id of B
    return checkpoint(n.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in order, counts, best) of the most frequent pairs, at most ``limit``."""
    level = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, None
    for at, n in sorted((tuple(r) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        total += n
        if total > limit:
            break
        least = at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(level >= least).toArrow()
    code, n, best = (rows.column(k).to_numpy() for k in ("code", "n", "best"))
    order = np.argsort(code)
    return code[order], n[order], best[order].astype(np.int64)


def with_counts(rows: DataFrame, counts: DataFrame, table: int = TABLE) -> DataFrame:
    """Rows of ``aligned``, with or without further columns, with n_best and count_sum in place of ``code`` and ``times``.

    The ``table`` most frequent pairs are summed where the rows are read; the others are joined to all counts."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent(counts, table))
    kept = [c for c in rows.columns if c not in ("code", "times")]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("_best", "_sum")),
                           *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_code", "_times"))])

    def run(batches):
        code, n, best = shared.value
        for b in small_batches(batches):
            lists = [b.column(c) for c in ("code", "times")]
            stops = lists[0].offsets.to_numpy().astype(np.int64)
            own, times = (x.flatten().to_numpy() for x in lists)
            stops = stops - stops[0]
            place = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
            hit = code[place] == own if len(code) else np.zeros(len(own), bool)
            sums = [np.concatenate(([0], np.cumsum(times * hit * x[place] if len(code) else times * 0)))[stops] for x in (best, n)]
            rest = np.concatenate(([0], np.cumsum(~hit)))[stops].astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(np.diff(x)) for x in sums), *rare], names=schema.names)

    out = checkpoint(rows.mapInArrow(run, schema)).withColumn("_row", F.monotonically_increasing_id())
    left = out.select("_row", F.explode(F.arrays_zip("_code", "_times")).alias("x")).select("_row", F.col("x._code").alias("code"), F.col("x._times").alias("times"))
    more = left.join(counts, "code").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_more_best"),
                                                         F.sum(F.col("n") * F.col("times")).alias("_more_sum"))
    return out.join(more, "_row", "left").select(
        *kept, (F.col("_best") + F.coalesce("_more_best", F.lit(0))).alias("n_best"), (F.col("_sum") + F.coalesce("_more_sum", F.lit(0))).alias("count_sum"))


def default_files() -> tuple[str, bytes]:
    """The public byte-level and SentencePiece files of the environment, where they are installed."""
    import public_tokenizers

    return read_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
