"""Uniform shuffle into shards of exact size by a hypergeometric communication
matrix (DataFrame functions only).

1. Rows are dealt to B source blocks by a hash of the whole row; B <= MAX_BLOCKS.
   The order within a block or shard, too, goes by hashes of the whole row, so
   rows that share a key but differ elsewhere are spread and have one order.
   Rows alike in every column are numbered, and their number is hashed with them.
2. Shard sizes are fixed (at most one apart).  How many rows of block b go to
   shard s is drawn exactly: block by block, from the hypergeometric law of the
   places that are left.  The matrix has at most MAX_BLOCKS x shards cells,
   drawn on the driver from the B block counts, and is broadcast.
3. Each block is permuted locally (rank by a keyed hash) and its ranks are cut
   at the matrix row's cumulated counts: that is the shard.
4. Rows are exchanged to their shard and permuted again by another hash; the
   rank there is the slot.

Ranks are computed in hash ranges of about RANGE_ROWS rows plus the count of
the ranges below, so no task sorts a whole block or shard.  Everything is a
function of seed and rows, whatever their partitions or order, so a recomputed
task gives the same rows.

Edge cases: null and repeated keys are rows like others; an empty table gives no
rows; fewer rows than shards leave shards empty; clashing column names get a
trailing underscore.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.llm import shared

MAX_BLOCKS = 1024
BLOCK_ROWS = 4096         # rows of a block at least, until MAX_BLOCKS is reached
RANGE_ROWS = 8192         # rows of a hash range
COPIES = 8192             # copies of one row written together


def draw(good: int, bad: int, n: int, u: float) -> int:
    """Hypergeometric value for the uniform number ``u``: walk outwards from the
    mode and take each probability off ``u``.  Works for any population."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    mode = min(max(lo, (n + 1) * (good + 1) // (good + bad + 2)), hi)
    lc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    up = p = q = math.exp(lc(good, mode) + lc(bad, n - mode) - lc(good + bad, n))
    i = j = mode
    u -= up
    while u > 0 and (i < hi or j > lo):
        if i < hi:
            p *= (good - i) * (n - i) / ((i + 1) * (bad - n + i + 1))
            i += 1
            u -= p
            if u <= 0:
                return i
        if j > lo:
            q *= j * (bad - n + j) / ((good - j + 1) * (n - j + 1))
            j -= 1
            u -= q
            if u <= 0:
                return j
    return mode


def matrix(block_rows: Sequence[int], shard_rows: Sequence[int], seed: int) -> list[list[int]]:
    """Exact counts block x shard with the given margins, drawn uniformly over
    all ways to deal the rows out."""
    rng = random.Random(seed)
    left = list(shard_rows)
    out = []
    for rows in block_rows:
        need, rest, counts = rows, sum(left), []
        for s, room in enumerate(left):
            got = draw(room, rest - room, need, rng.random())
            counts.append(got)
            left[s] -= got
            need -= got
            rest -= room
        out.append(counts)
    return out


def _numbered(docs: DataFrame, mark: str, copy: str) -> DataFrame:
    """``docs`` with two hashes of the whole row (``mark``, a struct) and, among
    rows alike in every column, a number from 0 (``copy``).  Rows that occur once
    stay where they are.  Others are counted before they move, and come back in
    pieces of COPIES rows, so no task writes a whole group of copies."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.withColumn(mark, F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b")))
    key, n, piece = (shared.fresh([*df.columns, copy], x) for x in ("row_hash", "n_copies", "copy_piece"))
    many = shared.staged(df.groupBy(F.col(f"{mark}.a").alias(key)).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(key))
    df, flag = shared.marked(df.withColumn(key, F.col(f"{mark}.a")), many, key)
    once = df.filter(~F.col(flag)).drop(flag, key).withColumn(copy, F.lit(0).cast("long"))
    again = (df.filter(flag).drop(flag, key).groupBy(*docs.columns, mark).agg(F.count("*").alias(n))
             .withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = (again.repartition(parts, F.col(f"{mark}.a"), F.col(piece))
             .withColumn(copy, F.explode(F.sequence(F.col(piece) * COPIES, F.least(F.col(n), (F.col(piece) + 1) * COPIES) - 1))))
    return once.unionByName(again.select(*once.columns))


def _rank(df: DataFrame, group: str, hash_col: str, ties: list[str], ranges: int, out: str) -> DataFrame:
    """Gapless rank from 0 inside ``group`` by ``hash_col``, in hash ranges."""
    r = shared.fresh([*df.columns, out], "hash_range")
    df = df.withColumn(r, F.shiftright(F.shiftrightunsigned(hash_col, 33) * F.lit(ranges), 31))
    sizes = df.groupBy(group, r).agg(F.count("*").alias("in_range"))
    below = sizes.select(group, r, (F.sum("in_range").over(
        Window.partitionBy(group).orderBy(r).rowsBetween(Window.unboundedPreceding, -1))).alias("rows_below"))
    w = Window.partitionBy(group, r).orderBy(hash_col, *ties)
    return (df.withColumn(out, F.row_number().over(w).cast("long") - 1)
            .join(below, [group, r])
            .withColumn(out, F.col(out) + F.coalesce("rows_below", F.lit(0)))
            .drop(r, "rows_below"))


def shard(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` (int, 0 .. n_shards - 1) and ``slot`` (long, gapless from 0)."""
    spark = docs.sparkSession
    cols = docs.columns
    shard_col, slot_col = shared.fresh(cols, "shard"), shared.fresh(cols, "slot")
    total = docs.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // BLOCK_ROWS)))
    b, h1, h2, r, cum, mark, copy = (shared.fresh([*cols, shard_col, slot_col, "rows_below", "in_range"], x)
                                     for x in ("src_block", "src_hash", "dst_hash", "src_rank", "shard_ends", "row_mark", "row_copy"))
    hashed = lambda k: F.xxhash64(F.lit(seed * 31 + k), F.col(mark), F.col(copy))
    df = (_numbered(docs, mark, copy).withColumn(b, F.pmod(hashed(0), F.lit(blocks)).cast("int"))
          .withColumn(h1, hashed(1)).withColumn(h2, hashed(2)))
    rows = {x[0]: x[1] for x in df.groupBy(b).count().collect()}          # at most MAX_BLOCKS
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    random.Random(seed).shuffle(sizes)
    counts = matrix([rows.get(i, 0) for i in range(blocks)], sizes, seed)
    ends = []
    for i, row in enumerate(counts):
        acc = 0
        ends.append((i, [acc := acc + x for x in row]))
    table = spark.createDataFrame(ends, f"`{b}` int, `{cum}` array<bigint>")
    df = _rank(df, b, h1, [mark, copy], max(1, -(-total // (blocks * RANGE_ROWS))), r)
    df = (df.join(F.broadcast(table), b)
          .withColumn(shard_col, F.expr(f"cast(size(filter(`{cum}`, e -> e <= `{r}`)) as int)"))
          .drop(b, h1, r, cum))
    df = _rank(df, shard_col, h2, [mark, copy], max(1, -(-total // (n_shards * RANGE_ROWS))), slot_col)
    return df.select(*cols, shard_col, slot_col)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder a shard, rows in slot order within each file."""
    (sharded.repartition(F.col(shard_col), F.shiftright(slot_col, 16))
     .sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path))
