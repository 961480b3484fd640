"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and proofs by checkpoint and recompute.

A row's leaf is the SHA-256 (lowercase hex) of its values in order, each ``-`` if null, else UTF-8 byte count, ``:``, value.
Per group the leaves stand in the order of a key; while more than one node remains, every ``FANOUT`` consecutive ones (the
last run may be shorter, even one) become the digest of their hex texts in a row.  What remains is the group's subroot.
The subroots, in the order of the group (null first, bytewise), become the root in the same way.

* Only every ``STEP``-th level is persisted (checkpoint), as aligned subtrees: one row holds the ``FANOUT ** STEP``
  consecutive nodes of that level that lie below one node of the next persisted level.
* Proofs go down from the root: a subtree's row regenerates the levels in between from its stored nodes, appends their
  siblings to the path of the node above it, and hands a path to each of its nodes; the regenerated digests and, on the
  lowest level, the paths are gone with the row.  Nothing wider than a subtree is held, and only nodes of
  persisted levels above the leaves are ever shuffled with their path.
* Places are found without a task that holds a group: rows are dealt out by ranges of (group, key, leaf), numbered
  where they lie, and shifted by the sizes of the ranges before.

DataFrame functions throughout.

Defined cases: every row is a leaf, repeated rows and null keys (first) included; rows of one key stand in the order of their
leaves; a group of one row has that leaf as its subroot and adds nothing to the proof; an empty table gives no row and
no root; columns that are not named are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint

FANOUT, STEP = 8, 3
WIDTH = FANOUT ** STEP


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values of a row."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows plus ``pos``, the place from 0 within the rows of one ``g`` in the given order, and ``n``, their number."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = checkpoint(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    group = Window.partitionBy("g")
    parts = dealt.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        "g", "_part", "_first", F.sum("_n").over(group).alias("n"),
        F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(parts, ["g", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_first", "_before")


def _above(nodes: Column) -> Column:
    """Digests of the runs of ``FANOUT`` nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _regenerated(blocks: DataFrame) -> DataFrame:
    """Subtrees plus h0 (stored digests), h1, ... of the levels above them; null where the group has no such level."""
    out = blocks.withColumn("h0", F.transform("nodes", lambda x: x["digest"]))
    for k in range(STEP):
        out = out.withColumn(f"h{k + 1}", F.when(F.col("n") > FANOUT ** k, _above(F.col(f"h{k}"))))
    return out


@dataclass
class Tree:
    """Persisted levels, lowest first, of a tree per group: (g, block, n, nodes), nodes being structs that begin with pos
    and digest; n counts the nodes of the group's level.  tops: (g, last, top), last being its highest persisted level."""

    levels: list[DataFrame]
    tops: DataFrame


def build(rows: DataFrame, payload: Sequence[str] = ()) -> Tree:
    """The trees over rows (g, pos, n, digest, *payload)."""
    levels, tops, level, extra = [], None, rows, list(payload)
    while True:
        blocks = level.groupBy("g", F.floor(F.col("pos") / WIDTH).cast("long").alias("block")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", *extra))).alias("nodes"))
        blocks = checkpoint(blocks)
        levels.append(blocks)
        highest = F.element_at(F.coalesce(*[F.col(f"h{k}") for k in range(STEP, -1, -1)]), 1)
        up = _regenerated(blocks).select("g", F.col("block").alias("pos"), "n", highest.alias("digest"))
        done = up.where(F.col("n") <= WIDTH).select("g", F.lit(len(levels) - 1).alias("last"), F.col("digest").alias("top"))
        tops = done if tops is None else tops.union(done)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= WIDTH:
            return Tree(levels, checkpoint(tops))
        level = up.where(F.col("n") > WIDTH).withColumn("n", F.ceil(F.col("n") / WIDTH).cast("long"))
        extra = []


def prove(tree: Tree, groups: DataFrame, emit: Callable[[Column, Column], Column]) -> DataFrame:
    """One row a leaf: the other columns of groups and those of the struct ``emit(leaf node, path)``.

    groups: (g, path, ...), the path of a group's top; a path is an array of (left, right), the hex texts of the siblings
    on either side, from the bottom up."""
    kept = [c for c in groups.columns if c not in ("g", "path")]
    groups = groups.join(tree.tops.select("g", "last"), "g")
    below = None
    for s in range(len(tree.levels) - 1, -1, -1):
        parents = groups.where(F.col("last") == s).select("g", F.lit(0).cast("long").alias("block"), "path", *kept)
        parents = parents if below is None else parents.union(below)
        blocks = _regenerated(tree.levels[s]).join(parents, ["g", "block"])

        def path(i):
            own = []
            for k in range(STEP):
                at = F.floor(i / FANOUT ** k).cast("int")
                inside, h = at % FANOUT, F.col(f"h{k}")
                own.append(F.when(F.col(f"h{k + 1}").isNotNull(), F.struct(
                    F.array_join(F.slice(h, at - inside + 1, inside), "").alias("left"),
                    F.array_join(F.slice(h, at + 2, FANOUT - 1 - inside), "").alias("right"))))
            return F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), F.col("path"))

        if s:
            found = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("block"), path(i).alias("path")))
            below = blocks.select("g", *kept, F.explode(found).alias("x")).select("g", "x.block", "x.path", *kept)
        else:
            found = F.transform("nodes", lambda x, i: F.element_at(F.transform(F.array(path(i)), lambda p: emit(x, p)), 1))
            return blocks.select(*kept, F.explode(found).alias("x")).select("x.*", *kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of the siblings' hex texts, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


@dataclass
class Manifest:
    """Trees of the groups and the tree over them; subroots: (g, subroot), root: (root)."""

    key: str
    rows: Tree
    groups: Tree

    @property
    def subroots(self) -> DataFrame:
        return self.rows.tops.select("g", F.col("top").alias("subroot"))

    @property
    def root(self) -> DataFrame:
        return self.groups.tops.select(F.col("top").alias("root"))

    def proofs(self, emit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """One row a leaf: (key, leaf, path) or the columns of ``emit(node, path)``, then subroot and root; a node has the
        fields key, digest and now (digest of the row as it is now, null if unchanged)."""
        none = F.array().cast("array<struct<left:string,right:string>>")
        top = prove(self.groups, self.groups.tops.select("g", none.alias("path"), F.col("top").alias("root")),
                    lambda x, p: F.struct(x["group"].alias("g"), x["digest"].alias("subroot"), p.alias("path")))
        shown = emit or (lambda x, p: F.struct(x["key"].alias(self.key), x["digest"].alias("leaf"), p.alias("path")))
        return prove(self.rows, checkpoint(top.select("g", "path", "subroot", "root")), shown)


def manifest(rows: DataFrame, columns: Sequence[str], group: str, key: str, now: dict[str, Column] | None = None) -> Manifest:
    """The manifest of rows over ``columns``; ``now`` gives the present values of columns whose rows may have been
    tampered with since."""
    now = now or {}
    leaf = leaf_digest([F.col(c) for c in columns])
    present = leaf_digest([now.get(c, F.col(c)) for c in columns])
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(g.alias("g"), F.col(key).alias("key"), leaf.alias("digest"), present.alias("now"))
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
    # digests are taken once; the number of the row deals out even rows that are equal in all columns
    leaves = checkpoint(leaves.withColumn("row", F.monotonically_increasing_id()))
    tree = build(numbered(leaves, ["key", "digest", "row"]), ["key", "now"])
    tops = tree.tops.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("top").alias("digest"))
    return Manifest(key, tree, build(numbered(tops, ["group"]), ["group"]))


def audit(m: Manifest) -> DataFrame:
    """One row a leaf: (key, leaf, subroot, root, proof_sha256, folded_root, verified): the present leaf folded with the
    stored siblings, and whether that gives the root."""
    rows = m.proofs(lambda x, p: F.struct(x["key"].alias(m.key), x["digest"].alias("leaf"), path_digest(p).alias("proof_sha256"),
                                          folded(F.coalesce(x["now"], x["digest"]), p).alias("folded_root")))
    return rows.select(m.key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
