r"""Chat formatting over reply trees (DataFrame functions only).

Messages (tree, node, parent, role, text, score) form trees of replies.

1. Self-joins enumerate the paths upwards by doubling: after round k a node
   knows its 2^k-th ancestor, and the score and length of the path in between,
   so a path of d messages takes log2(d) joins.  Only ids and scores move.
2. A branch is a path from a root to a leaf.  Its score is the mean score of
   its messages (null scores do not count, none at all: 0).  The branches of a
   tree are ranked by score, ties to the smaller leaf; the first ``top`` stay.
3. The same links, taken from the largest stride down, give the messages of
   each chosen path.
4. Each path becomes one conversation: a turn is ``<|im_start|>role\n``, the
   text, ``<|im_end|>\n``.  Inside roles and texts one more backslash goes
   between ``<`` and ``|`` wherever only backslashes (or nothing) stand between
   them, so no control string is left and nothing is lost; ``%`` and newlines of
   roles are written %25 and %0A.  ``loss_spans`` marks the texts of assistants,
   as offsets in characters (code points) and in UTF-8 bytes.

A conversation is one row, so its turns meet in one task; a tree's branches do
not, and a hot parent is a skewed join side that AQE can split.

Edge cases: null role or text: empty; a parent that is not in the tree, or the
message itself: a root; messages below a circle of replies have no root and are
in no branch; a message without node id is left out; of messages with one id in
one tree the first by (parent, role, text, score) stays; a null tree id is a
tree; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.llm import shared

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chains(turns: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages of plain conversations: each row replies to the row before it,
    by turn (ties, and null turns first, by role and text)."""
    rows = shared.staged(turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
                         .withColumn("node", F.monotonically_increasing_id()))
    by_turn = Window.partitionBy("tree").orderBy("turn", "role", "text_hash", "node")
    replies = (rows.select("tree", "turn", "role", F.sha2("text", 256).alias("text_hash"), "node")
               .select("node", F.lag("node").over(by_turn).alias("parent")))
    return rows.drop("turn").join(replies, "node").withColumn("score", F.lit(None).cast("double"))


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, pos): the messages of the ``top`` best
    branches of each tree (None: of all), ``pos`` counted from the root."""
    ids = messages.filter("node is not null").groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    ids = shared.staged(ids.select("tree", "node", F.when(F.col("m.parent") != F.col("node"), F.col("m.parent")).alias("parent"),
                                   F.col("m.score").alias("score")))
    parents = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = (ids.alias("a").join(parents.alias("b"), _same("a", "b", "parent", "parent"), "left")
             .select("a.tree", "a.node", F.when(F.col("b.there"), F.col("a.parent")).alias("up"),
                     F.coalesce("a.score", F.lit(0.0)).alias("total"), F.when(F.col("a.score").isNotNull(), 1).otherwise(0).cast("long").alias("scored"),
                     F.lit(1).cast("long").alias("length")))
    open_ = shared.staged(state)
    n_nodes, stride, strides, done = open_.count(), 1, [], []
    while True:
        links = open_.filter("up is not null")
        if links.isEmpty() or stride > n_nodes:
            break
        strides.append(links.select("tree", "node", "up"))
        done.append(open_.filter("up is null"))     # these have reached their root and only serve as ancestors
        every = reduce(DataFrame.unionByName, done, links)
        add = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c)
        open_ = shared.staged(links.alias("a").join(every.alias("b"), _same("a", "b", "up", "node"))
                              .select("a.tree", "a.node", F.col("b.up").alias("up"), add("total"), add("scored"), add("length")))
        stride *= 2
    state = reduce(DataFrame.unionByName, done, open_.filter("up is null"))
    replied = strides[0] if strides else state.select("tree", "node", "up")     # no parents: "up" is null
    leaves = (state.alias("a")
              .join(replied.alias("b"), _same("a", "b", "node", "up"), "left_anti")
              .select("tree", F.col("node").alias("leaf"), "length",
                      F.when(F.col("scored") > 0, F.col("total") / F.col("scored")).otherwise(F.lit(0.0)).alias("score")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    leaves = leaves.withColumn("rank", rank)
    leaves = shared.staged(leaves.filter(F.col("rank") <= top) if top is not None else leaves)
    on = [leaves.select("*", F.col("leaf").alias("node"), (F.col("length") - 1).alias("pos"))]
    for k in range(len(strides) - 1, -1, -1):
        so_far = reduce(DataFrame.unionByName, on)
        on.append(shared.staged(so_far.alias("a").join(strides[k].alias("b"), _same("a", "b", "node", "node"))
                                .select(*[f"a.{c}" for c in leaves.columns], F.col("b.up").alias("node"), (F.col("a.pos") - (1 << k)).alias("pos"))))
    return reduce(DataFrame.unionByName, on).drop("length")


def conversations(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans): one row a chosen branch."""
    said = messages.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")) \
        .select("tree", "node", F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    key = ["tree", "leaf", "rank", "score"]
    turns = (branches(messages, top).alias("a").join(said.alias("b"), _same("a", "b", "node", "node"))
             .select(*[f"a.{c}" for c in key], "a.pos", (F.col("b.role") == LEARNT).alias("learnt"),
                     F.concat(F.lit(START), escape_role(F.coalesce("b.role", F.lit(""))), F.lit("\n")).alias("head"),
                     escape(F.coalesce("b.text", F.lit(""))).alias("body")))
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    for unit, size in (("", F.length), ("byte_", F.octet_length)):
        whole = (size("head") + size("body") + len(END)).cast("long")
        turns = (turns.withColumn(f"{unit}start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + size("head"))
                 .withColumn(f"{unit}end", F.col(f"{unit}start") + size("body")))
    span = F.struct("start", "end", "byte_start", "byte_end")
    one = turns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("t"),
                                  F.sort_array(F.collect_list(F.when(F.col("learnt"), span))).alias("loss_spans"))
    return one.select(*key, F.array_join(F.col("t.turn"), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def parts(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(unescape_role(F.substring(role, len(START) + 1, F.length(role))).alias("role"),
                        unescape(F.substring(t, F.length(role) + 2, F.length(t))).alias("text"))

    return F.transform(turns, parts)


def learnt_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss spans, joined without anything between."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string"))), "")
