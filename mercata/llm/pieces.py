"""SentencePiece encoding and decoding over a relational lattice.

Text is normalised as the model file says (a dummy space in front, spaces written as U+2581) and cut into
segments: a run of letters or a run of other characters, each with the spaces before it.  No piece of the
vocabulary crosses such a cut (checked when the model is loaded; otherwise the cut is made before
spaces only), so segments can be encoded apart.

The encoding is what the library gives for the model file, by the model's type:

* UNIGRAM: the Viterbi path, of all ways to write a segment as pieces the one with the largest sum of
  piece scores (equal sums: the longest last piece);
* BPE: the best-scored piece that two neighbours make is merged, leftmost first, until no piece joins two.
  A Viterbi path over the scores of a BPE model would be another text: it gives the library's ids for
  only 43 % of the distinct test words, so the same lattice is folded by merges.

A character that is no piece is written as its UTF-8 byte pieces (UNIGRAM: at the lowest score less 10).

* Frequent segments (``FREQUENT`` at most, by corpus counts) are encoded as relations: explode the substrings
  of at most the longest piece's length, equi-join them to the piece table, group the edges by segment, and fold
  the recursion over them with Spark's ``aggregate``.
* Their ids, a table of bounded size, are broadcast, and the texts are encoded where they are read: no text is
  shuffled.  A segment outside the table (rare, or over ``LONGEST`` characters) is encoded on the spot by the
  same rule over the same pieces.

Decoding is exact: byte pieces give back their bytes, and U+2581 of the text itself is written as bytes.

Defined cases: null gives a null list; an empty text gives no ids; rows are kept one to one, other columns
untouched; an empty table gives none.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercata.llm.common import checkpoint, small_batches

SPACE = "▁"
FREQUENT, LEAST_COUNT, LONGEST = 1 << 18, 4, 32
INF = float("inf")
#: Segments: spaces, then a run of letters or a run of others; or spaces, then all up to the next space.
FINE = rf"{SPACE}*(?:[^\W\d_¹²³]+|(?:[^\w{SPACE}]|[\d_¹²³])+)|{SPACE}+"
COARSE = rf"{SPACE}*[^{SPACE}]+|{SPACE}+"


class Model:
    """Pieces, scores and byte pieces of a model file; read on the driver, sent to the tasks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece, self.bytes, self.shown = {}, [0] * 256, []
        for i in range(len(sp)):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.shown.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.shown.append(b"")
            else:
                self.piece[name] = (i, sp.get_score(i))
                self.shown.append(name.replace(SPACE, " ").encode("utf-8"))
        self.cost = {p: -s for p, (_, s) in self.piece.items()}
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, s in self.piece.values()) - 10
        fine = re.compile(FINE)
        self.cut = FINE if all(len(fine.findall(p)) == 1 for p in self.piece) else COARSE

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8")]

    def path(self, segment: str) -> list[int]:
        """Ids of one segment by the model's rule, for segments outside the table."""
        return self.merge(segment) if self.merges else self.viterbi(segment)

    def merge(self, segment: str) -> list[int]:
        """Best-scored merges first, leftmost on ties."""
        if len(segment) > 64:
            return self.merge_long(segment)
        cost, parts = self.cost.get, list(segment)
        pairs = [cost(a + b, INF) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < INF:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = cost(parts[i - 1] + parts[i], INF)
            if i < len(pairs):
                pairs[i] = cost(parts[i] + parts[i + 1], INF)
        out = []
        for p in parts:
            out += [self.piece[p][0]] if p in self.piece else self.spell(p)
        return out

    def merge_long(self, segment: str) -> list[int]:
        """The same by a queue of pairs over a linked list of pieces."""
        n, piece = len(segment), self.piece
        after, before, end, queue = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), []

        def offer(left):
            right = after[left]
            if right < n and (p := piece.get(segment[left:end[right]])) is not None:
                heapq.heappush(queue, (-p[1], left, right, end[right]))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, left, right, stop = heapq.heappop(queue)
            if end[left] != right or right >= n or end[right] != stop or after[left] != right:
                continue  # one of the two has been merged meanwhile
            end[left], after[left], end[right] = stop, after[right], -1
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out, k = [], 0
        while k < n:
            p = piece.get(segment[k:end[k]])
            out += [p[0]] if p else self.spell(segment[k:end[k]])
            k = after[k]
        return out

    def viterbi(self, segment: str) -> list[int]:
        """Path of the largest sum of scores."""
        n, piece = len(segment), self.piece
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        for end in range(1, n + 1):
            best, via = score[end - 1] + self.unknown, (end - 1, -1)
            for start in range(max(0, end - self.longest), end):
                if (p := piece.get(segment[start:end])) is not None:
                    s = score[start] + p[1]
                    if s > best or (s == best and (via[1] < 0 or start < via[0])):
                        best, via = s, (start, p[0])
            score[end], back[end] = best, via
        out, end = [], n
        while end:
            start, i = back[end]
            out.append([i] if i >= 0 else self.spell(segment[start:end]))
            end = start
        return [i for part in reversed(out) for i in part]


def _parts(text: str) -> list[str]:
    """The normalised text between the U+2581 of the text itself."""
    first, *rest = text.split(SPACE)
    return [(SPACE + first).replace(" ", SPACE), *(r.replace(" ", SPACE) for r in rest)]


def segment_counts(texts: DataFrame, text_col: str, cut: str) -> DataFrame:
    """(segment, n) over all texts; tasks count what they read before anything is shuffled."""
    def run(batches):
        find, seen = re.compile(cut).findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["segment", "n"])

        for b in batches:
            for text in b.column(0):
                text = text.as_py()
                if text:
                    for part in _parts(text):
                        seen.update(find(part))
                    if len(seen) > 400_000:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return texts.select(text_col).mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def lattice(segments: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(segment, edges): every piece at every place of the segment, as structs (end, start, id, score)."""
    n = F.length("segment")
    starts = segments.select("segment", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    ends = starts.select("segment", "start", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + longest))).alias("end"))
    parts = ends.withColumn("piece", F.substring("segment", F.col("start") + 1, F.col("end") - F.col("start")))
    # the piece table has the model's fixed size
    edges = parts.join(F.broadcast(pieces), "piece")
    return edges.groupBy("segment").agg(F.collect_list(F.struct("end", "start", "id", "score")).alias("edges"))


def best_paths(segments: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """(segment, path): ids of the best path; -1 - p stands for the character at place p that is no piece."""
    rows = segments.join(lattice(segments, pieces, longest), "segment", "left")
    none = F.array().cast("array<int>")
    start = F.array(F.struct(F.lit(0.0).alias("score"), none.alias("path")))

    def step(state, end):
        via = F.transform(
            F.filter(F.coalesce("edges", F.array().cast("array<struct<end:int,start:int,id:int,score:double>>")), lambda e: e["end"] == end),
            lambda e: F.struct((F.element_at(state, e["start"] + 1)["score"] + e["score"]).alias("score"),
                               (-e["start"]).alias("first"),
                               F.concat(F.element_at(state, e["start"] + 1)["path"], F.array(e["id"])).alias("path")))
        before = F.element_at(state, end)
        spelt = F.struct((before["score"] + F.lit(unknown)).alias("score"), (-end).alias("first"),
                         F.concat(before["path"], F.array((-end).cast("int"))).alias("path"))
        best = F.array_max(F.concat(via, F.array(spelt)))
        return F.concat(state, F.array(F.struct(best["score"].alias("score"), best["path"].alias("path"))))

    path = F.aggregate(F.sequence(F.lit(1), F.length("segment")), start, step, lambda s: F.element_at(s, -1)["path"])
    return rows.select("segment", path.alias("path"))


def merged_paths(segments: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(segment, path) by merges; -1 - p stands for the character at place p that is no piece."""
    wide = 1 << 16  # an edge's key: start * wide + end
    rows = segments.join(lattice(segments, pieces, longest), "segment", "left")
    edges = F.map_from_entries(F.transform(
        F.coalesce("edges", F.array().cast("array<struct<end:int,start:int,id:int,score:double>>")),
        lambda e: F.struct((e["start"] * wide + e["end"]).alias("key"), F.struct(e["score"], e["id"]).alias("value"))))
    rows = rows.select("segment", edges.alias("edge"))

    def edge(a, b):
        return F.try_element_at(F.col("edge"), a * wide + b)

    def step(cuts, _):
        inner = F.sequence(F.lit(1), F.size(cuts) - 2)
        pairs = F.filter(F.transform(inner, lambda k: F.struct(edge(F.get(cuts, k - 1), F.get(cuts, k + 1))["score"].alias("score"),
                                                               (-k).alias("first"))), lambda x: x["score"].isNotNull())
        best = F.array_max(pairs)["first"]
        return F.when((F.size(cuts) > 2) & (F.size(pairs) > 0), F.filter(cuts, lambda x, i: i != -best)).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.length("segment")), F.sequence(F.lit(0), F.length("segment")), step)
    rows = rows.withColumn("cuts", cuts)
    path = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.coalesce(
        edge(F.get("cuts", k - 1), F.get("cuts", k))["id"], -1 - F.get("cuts", k - 1)))
    return rows.select("segment", path.alias("path"))


def frequent_table(texts: DataFrame, text_col: str, model: Model, limit: int = FREQUENT) -> tuple[list[str], pa.ListArray]:
    """(segments, paths) of the most frequent segments; at most ``limit``."""
    spark = texts.sparkSession
    counts = segment_counts(texts, text_col, model.cut).where((F.col("n") >= LEAST_COUNT) & (F.length("segment") <= LONGEST))
    counts = checkpoint(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    total, least = 0, None
    for level, n in sorted((tuple(r) for r in counts.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > limit:
            break
        least = level
    if least is None:
        return [], pa.array([], pa.list_(pa.int32()))
    table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in model.piece.items()], "piece string, id int, score double")
    chosen = counts.where(F.col("level") >= least).select("segment")
    paths = (merged_paths(chosen, table, model.longest) if model.merges
             else best_paths(chosen, table, model.longest, model.unknown)).toArrow()
    return paths.column("segment").to_pylist(), paths.column("path").combine_chunks()


class Paths:
    """Ids of numbered segments, as one array and its offsets."""

    def __init__(self, paths: list[tuple[int, ...]], shown: list[bytes]):
        self.raw = [b"".join([shown[x] for x in p]) for p in paths]
        self.size = np.array([len(p) for p in paths], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.flat = np.array([x for p in paths for x in p], np.int32)

    def gather(self, numbers: np.ndarray, extra: "Paths") -> tuple[np.ndarray, np.ndarray]:
        """(ids of the segments in order, end of each in them, from 0); numbers beyond are those of ``extra``."""
        size = np.concatenate((self.size, extra.size))[numbers]
        first = np.concatenate((self.first, extra.first + len(self.flat)))[numbers]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
        return np.concatenate((self.flat, extra.flat))[place], ends


def shown_text(ids: list[int], shown: list[bytes]) -> str:
    """The text of piece ids."""
    raw = b"".join([shown[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids",
           check_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs plus ``out_col`` (in place of a column of that name), the piece ids of each text.

    ``check_col`` adds whether decoding the ids gives the text back (null: true); ``keep`` names the columns
    of docs to return, all if None.
    """
    docs = docs.drop(out_col, *([check_col] if check_col else []))
    names = docs.columns if keep is None else keep
    model = Model(model_path)
    segments, paths = frequent_table(docs, text_col, model)
    shared = docs.sparkSession.sparkContext.broadcast((model, segments, np.asarray(paths.flatten()), np.asarray(paths.offsets)))
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField(out_col, T.ArrayType(T.IntegerType())),
                           *([T.StructField(check_col, T.BooleanType())] if check_col else [])])

    def run(batches):
        model, segments, flat, at = shared.value
        flat, at = flat.tolist(), at.tolist()
        paths = [tuple(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        paths = [p if min(p) >= 0 else tuple(x for y in p for x in ([y] if y >= 0 else model.spell(s[-1 - y]))) for s, p in zip(segments, paths)]
        known = {s: i for i, s in enumerate(segments)}
        known[""] = len(paths)  # stands for U+2581 of the text itself
        paths.append(tuple(model.spell(SPACE)))
        common, base = Paths(paths, model.shown), len(paths)
        del paths, flat, at, segments
        find, rare = re.compile(model.cut).findall, {}
        for b in small_batches(batches):
            texts, segs, cut = b.column(text_col).to_pylist(), [], [0]
            for text in texts:
                if text:
                    for k, part in enumerate(_parts(text)):
                        if k:
                            segs.append("")
                        segs += find(part)
                cut.append(len(segs))
            at = np.array(list(map(known.get, segs, repeat(-1))), np.int64)
            here, extra = {}, []
            for i in np.flatnonzero(at < 0).tolist():
                s = segs[i]
                n = here.get(s)
                if n is None:
                    n = here[s] = base + len(extra)
                    path = rare.get(s)
                    if path is None:
                        path = tuple(model.path(s))
                        if len(s) <= LONGEST:
                            rare[s] = path
                    extra.append(path)
                at[i] = n
            more = Paths(extra, model.shown)
            ids, ends = common.gather(at, more)
            offsets = ends[cut]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids),
                                             mask=pa.array([t is None for t in texts]) if None in texts else None)
            checks = []
            if check_col:
                raw = common.raw + more.raw
                which = at.tolist()
                shown = [b"".join([raw[x] for x in which[i:j]])[1:] for i, j in zip(cut[:-1], cut[1:])]
                checks = [pa.array([s == (t or "").encode() for s, t in zip(shown, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists, *checks], names=schema.names)
            if len(rare) > 150_000:
                rare = {}

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows plus ``out_col`` (in place of a column of that name), the text of the piece ids."""
    rows = rows.drop(out_col)
    shown = Model(model_path).shown
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        for b in small_batches(batches):
            out = []
            for ids in b.column(ids_col):
                if not ids.is_valid:
                    out.append(None)
                    continue
                out.append(shown_text(ids.values.to_numpy().tolist(), shown))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def default_model() -> str:
    """The public 32k model of the environment, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")

