"""Reply trees and the way back from formatted texts."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat

TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_paths_of_random_trees(spark):
    r = random.Random(3)
    rows, parents = [], {}
    for conv in (1, 2, 3):
        for node in range(40 * conv):
            parent = r.randrange(max(0, node - 3), node) if node and r.random() < 0.95 else None
            parents[conv, node] = parent
            rows.append((conv, node, parent, "user", f"t{node}", r.random()))
    tree = spark.createDataFrame(rows, TREE)
    score = {(x[0], x[1]): x[5] for x in rows}
    inner = {(c, p) for (c, _), p in parents.items() if p is not None}
    want = {}
    for conv, node in parents:
        if (conv, node) not in inner:
            path, at = [], node
            while at is not None:
                path.insert(0, at)
                at = parents[conv, at]
            want[conv, node] = path
    got, ranks = {}, {}
    for x in chat.paths(tree).orderBy("position").collect():
        got.setdefault((x.conv_id, x.path), []).append(x.node)
        ranks[x.conv_id, x.path] = x.rank
    assert got == want
    for conv in (1, 2, 3):
        order = sorted((k for k in want if k[0] == conv), key=lambda k: (-sum(score[conv, n] for n in want[k]) / len(want[k]), k[1]))
        assert [ranks[k] for k in order] == list(range(1, len(order) + 1))
    assert {x.path for x in chat.paths(tree, best=1).collect()} == {k[1] for k in want if ranks[k] == 1}


def test_round_trip_of_tricky_texts(spark):
    tricky = ["</turn>\n", "<turn>assistant<text>x</turn>\n", "\\", "\\l", "\\\\b<", "a>b\n\n", "", "😀 <text>", "\\### Assistant: </turn> ok"]
    rows = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for t in tricky for r in ("user", "assistant", "<odd>\\ro\nle"))]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_paths(chat.linear_tree(talk))
    back = chat.read_back(formatted).orderBy("position").collect()
    assert [(x.role, x.text) for x in back] == [(r, t) for _, _, r, t in rows]
    assert [x.masked for x in back] == [r == "assistant" for _, _, r, _ in rows]
    row = formatted.first()
    whole = "".join(row.formatted[s["start"] : s["start"] + s["size"]] for s in row.loss_spans)
    for plain, code in reversed(chat.ESCAPES):
        whole = whole.replace(code, plain)
    assert whole == "".join(tricky)


def test_awkward_conversations(spark):
    rows = [
        (None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "c"), (1, None, "user", "d"),
        (2, 5, "assistant", None),
    ]
    talk = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, node int")
    back = chat.read_back(chat.format_paths(chat.linear_tree(talk))).orderBy("conv_id", "position").collect()
    said = {}
    for x in back:
        said.setdefault(x.conv_id, []).append((x.role, x.text, x.masked))
    assert said == {
        None: [("", "", False), ("user", "a", False)],
        1: [("user", "d", False), ("assistant", "c", True), ("user", "b", False), ("user", "b", False)],
        2: [("assistant", "", True)],
    }


def test_deep_chain_and_empty(spark):
    talk = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    back = chat.read_back(chat.format_paths(chat.linear_tree(talk))).orderBy("position").collect()
    assert [x.text for x in back] == [str(k) for k in range(700)]
    assert chat.format_paths(chat.linear_tree(talk.limit(0))).count() == 0


def test_circles(spark):
    tree = spark.createDataFrame([(1, 0, 1, "u", "a", 0.0), (1, 1, 0, "u", "b", 0.0), (2, 0, None, "u", "c", None), (2, 1, 9, "u", "d", 1.0)], TREE)
    assert sorted((x.conv_id, x.path) for x in chat.paths(tree).collect()) == [(2, 0), (2, 1)]
    tail = spark.createDataFrame([(1, 0, 1, "u", "a", 0.0), (1, 1, 2, "u", "b", 0.0), (1, 2, 0, "u", "b", 0.0), (1, 3, 0, "u", "c", 0.0)], TREE)
    with pytest.raises(ValueError, match="circle"):
        chat.paths(tail).count()
