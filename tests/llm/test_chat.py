"""Chat formatting: exact round trip of roles, texts and the loss mask; trees, ranks, cycles."""

from pyspark.sql import functions as F

from mercata.llm import chat

NASTY = ["", "plain", "<|end|>\n", "<|start:user|>\nhi", "<\\|end|>", "<\\\\|x", "|>\n", "<", "<|", "\\", "a<|end|>\n<|start:x|>\nb", "é<|😀", "\n\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(t, i, i - 1 if i else None, NASTY[(t + i) % len(NASTY)] if t % 2 else "assistant", NASTY[(3 * t + i) % len(NASTY)], 1.0, "x")
            for t in range(26) for i in range(5)]
    df = spark.createDataFrame(rows, "tree_id int, node_id int, parent_id int, role string, text string, score double, leaf string")
    out = chat.format_trees(df).select("tree_id", chat.read_back(F.col("formatted")).alias("t"),
                                       chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(out) == 26
    for r in out:
        mine = [(x[3], x[4]) for x in rows if x[0] == r.tree_id]
        assert [(x.role, x.text) for x in r.t] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")


def test_trees_ranks_repeats_and_cycles(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0),
            (1, 4, 3, "user", None, 0.5), (1, 4, 3, "user", None, 0.5), (1, 5, 2, None, "t", 1.5),
            (2, 7, 99, "user", "parent not there", 1.0),
            (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (3, 3, 1, "user", "z", 1.0)]
    df = spark.createDataFrame(rows, "tree_id int, node_id int, parent_id int, role string, text string, score double")
    got = {(r.tree_id, r.leaf): (r.branch_rank, r.branch_score, r.formatted) for r in chat.format_trees(df).collect()}
    assert set(got) == {(1, 4), (1, 5), (2, 7)}
    assert got[1, 4][:2] == (1, 2.5) and got[1, 5][:2] == (2, 2.5)  # equal scores: the smaller leaf first
    assert got[1, 4][2] == "<|start:user|>\nq<|end|>\n<|start:assistant|>\nb<|end|>\n<|start:user|>\n<|end|>\n"
    best = chat.format_trees(df, keep=1).collect()
    assert sorted((r.tree_id, r.leaf) for r in best) == [(1, 4), (2, 7)]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_long_chain(spark):
    df = spark.range(200).select(F.lit(1).alias("tree_id"), F.col("id").alias("node_id"),
                                 F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"),
                                 F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    (r,) = chat.format_trees(df).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert [x.text for x in r.t] == [str(i) for i in range(200)]
