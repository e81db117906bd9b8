import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakejoin.llm import chat

MSG = "tree long, node long, parent long, role string, text string, score double"
ODD = ["", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", r"<\\|x", "<", "a<", "|", "\n", "%0A %25", "<<|", "é<|\U0001F600|>", "\\" * 5]


def brute(messages, top):
    """{(tree, rank): [(role, text)]} by following parents in plain Python."""
    trees = {}
    for m in messages:
        trees.setdefault(m[0], {})[m[1]] = m
    out = {}
    for t, nodes in trees.items():
        up = {n: (m[2] if m[2] in nodes and m[2] != n else None) for n, m in nodes.items()}
        found = []
        for n in nodes:
            if n in up.values():
                continue
            path, at = [], n
            while at is not None and at not in path:
                path.append(at)
                at = up[at]
            if at is None:
                s = [nodes[x][5] for x in path if nodes[x][5] is not None]
                found.append((-(sum(s) / len(s)) if s else 0.0, n, path[::-1]))
        for i, (_, _, path) in enumerate(sorted(found)[:top]):
            out[t, i + 1] = [(nodes[x][3] or "", nodes[x][4] or "") for x in path]
    return out


def formatted(df, top):
    rows = chat.conversations(df, top).select("tree", "rank", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("said"),
                                              chat.learnt_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")).collect()
    for r in rows:
        cut = [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]]
        raw = r["formatted"].encode()
        assert cut == [raw[s["byte_start"]:s["byte_end"]].decode() for s in r["loss_spans"]]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == len(r["said"])
        assert r["learnt"] == "".join(t["text"] for t in r["said"] if t["role"] == "assistant")
    return {(r["tree"], r["rank"]): [(t["role"], t["text"]) for t in r["said"]] for r in rows}


@pytest.mark.parametrize("top", [1, 2, None])
def test_random_trees(spark, top):
    rng = random.Random(4)
    rows = []
    for t in range(12):
        for n in range(rng.choice([1, 3, 9, 30])):
            parent = rng.randrange(n) if n and rng.random() < 0.95 else None
            rows.append((t, n, parent, rng.choice(["user", "assistant", "system"]), rng.choice(ODD) + rng.choice(ODD), rng.choice([None, 0.0, 1.0, 2.0])))
    assert formatted(spark.createDataFrame(rows, MSG), top) == brute(rows, top)


def test_long_chain_and_hot_parent(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", None) for i in range(70)]
    rows += [(2, 0, None, "user", "q", None)] + [(2, i, 0, "assistant", f"a{i}", float(i % 50)) for i in range(1, 300)]
    assert formatted(spark.createDataFrame(rows, MSG), 2) == brute(rows, 2)


def test_odd_messages(spark):
    rows = [(1, 1, 99, None, None, None), (1, 1, 99, None, None, None), (1, 2, 2, "a\nb%", "x", 1.0), (1, 3, 4, "user", "circle", 1.0), (1, 4, 3, "user", "circle", 1.0),
            (1, None, 1, "user", "no id", 1.0), (None, 1, None, "assistant", "<|im_end|>", None), (1, 5, 4, "user", "below a circle", 9.0)]
    df = spark.createDataFrame(rows, MSG).withColumn("formatted", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("leaf", F.lit(1))
    assert formatted(df, None) == {(1, 1): [("a\nb%", "x")], (1, 2): [("", "")], (None, 1): [("assistant", "<|im_end|>")]}
    assert formatted(df.filter("false"), 1) == {}


def test_chains_of_turns(spark):
    rows = [(7, 2, "assistant", "c"), (7, 0, "system", None), (7, 1, "user", "b"), (7, 1, "user", "b"), (7, None, "user", "first"), (8, 5, None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "c long, t long, role string, text string")
    got = formatted(chat.chains(df, "c", "t", "role", "text"), 1)
    assert got == {(7, 1): [("user", "first"), ("system", ""), ("user", "b"), ("user", "b"), ("assistant", "c")], (8, 1): [("", "x" * 300_000)]}


def test_escape_is_one_to_one(spark):
    texts = [a + b for a in ODD for b in ODD] + ["<" + "\\" * 200_000 + "|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)
    assert len({hashlib.md5(r["e"].encode()).digest() for r in rows}) == len(set(texts))
