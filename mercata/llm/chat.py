r"""Chat formatting of reply trees.

Input rows are messages of trees: a message names the message that it answers (null: a root).  Iterative
self-joins that double their reach (``up`` holds the ancestor 2**i answers back) enumerate every
root-to-leaf path in log2(depth) rounds; a path's score is the sum of its messages' scores, branches of a
tree are ranked by score (ties: smaller leaf), and each chosen path is formatted as one conversation.

The format of a turn is ``<|start:ROLE|>`` newline TEXT ``<|end|>`` newline.  Control strings inside roles
and texts are escaped: ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on (in roles ``|>`` likewise), so
no text can hold a marker, and dropping one backslash between ``<`` and ``|`` restores it exactly.

The loss mask is a list of (start, length) spans in code points of the formatted string: the escaped
texts of assistant turns, without their markers.

Defined cases: a null text or role is empty; a message whose parent is not in the tree is a root;
messages with equal ids in a tree count once (smallest role, text); a message whose answers run into a
cycle has no root and is in no path; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercata.llm.common import checkpoint

ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|start:", "|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def paths(messages: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """(tree, leaf, node, back): every message of every root-to-leaf path, ``back`` answers before the leaf."""
    m = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent")) \
        .groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    known = m.select("tree", F.col("node").alias("parent"))
    links = m.where(F.col("parent").isNotNull()).join(known, ["tree", "parent"])  # a parent not there: a root
    up = checkpoint(links.select("tree", "node", F.col("parent").alias("anc")))
    reach, step, size = [], 1, m.count()
    while not up.isEmpty():
        if step > size:  # whoever still has an ancestor that far back answers into a cycle
            leaves = m.join(up.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        reach.append((step, up))
        far = up.select("tree", F.col("node").alias("anc"), F.col("anc").alias("next"))
        up, step = checkpoint(up.join(far, ["tree", "anc"]).select("tree", "node", F.col("next").alias("anc"))), 2 * step
    else:
        leaves = m
    leaves = leaves.join(links.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for step, up in reach:
        further = walk.join(up, ["tree", "node"]).select("tree", "leaf", F.col("anc").alias("node"),
                                                         (F.col("back") + step).alias("back"))
        walk = checkpoint(walk.union(further))
    return walk


def format_trees(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id",
                 role: str = "role", text: str = "text", score: str = "score", keep: int | None = None) -> DataFrame:
    """One row per chosen branch: (tree, leaf, branch_rank, branch_score, formatted, loss_mask).

    ``keep`` best branches of each tree are formatted; None formats all.
    """
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    m = (messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
                         F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), text_of.alias("text"),
                         F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
         .groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
         .select("tree", "node", "m.*"))
    walk = paths(m, "tree", "node", "parent")
    scored = walk.join(m.select("tree", "node", "score"), ["tree", "node"])
    ranked = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"), F.max("back").alias("depth")) \
        .withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    chosen = ranked if keep is None else ranked.where(F.col("branch_rank") <= keep)
    turns = (walk.join(chosen, ["tree", "leaf"]).join(m.select("tree", "node", "role", "text"), ["tree", "node"])
             .select("tree", "leaf", "branch_rank", "branch_score", "depth", "back",
                     F.concat(F.lit(ROLE_OPEN), escape_role(F.col("role")), F.lit(ROLE_CLOSE)).alias("head"),
                     escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")))
    one = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(
        F.array_sort(F.collect_list(F.struct((F.col("depth") - F.col("back")).alias("nth"), "head", "body", "loss"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_CLOSE))), "")
    # the mask's starts: a running length over the turns
    mask = F.aggregate(
        "t", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(TURN_CLOSE)).cast("long").alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return one.select(F.col("tree").alias(tree), "leaf", "branch_rank", "branch_score",
                      whole.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), unescaped."""
    def turn(p):
        close = F.instr(p, ROLE_CLOSE)
        return F.struct(
            unescape_role(F.substring(p, F.lit(len(ROLE_OPEN) + 1), close - (len(ROLE_OPEN) + 1))).alias("role"),
            unescape(F.substring(p, close + len(ROLE_CLOSE), F.length(p))).alias("text"))

    parts = F.split(formatted, r"<\|end\|>\n")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
