"""Similarity joins.

Spark has no operator for ``cos(a, b) > alpha``; a plain theta join would be a
nested loop.  Two exact physical paths, same results:

* **sparse equi-join** on the hash dimension: ``(id, dim, w)`` rows joined on
  ``dim`` and summed -- an inverted index executed as a shuffle join (AQE
  splits hot dimensions).  Integer weights make the dot products exact.
* **dense block matmul**: ids hashed into blocks, each block pair co-grouped
  and multiplied with numpy inside ``applyInPandas``; only reduced results
  leave the task (per-block top-K, or matched query rows per candidate table),
  so output stays O(rows x tables), never O(rows^2).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.functions.vectors import COS_EPS, NORM_EPS
from lakejoin.operators.encode import sparse_norms
from lakejoin.operators.order import global_index
from lakejoin.operators.rank import rank_within
from lakejoin.session import cut_lineage

HOT_LIST = 8192    # columns of one dimension in one part of the join
SEED_LIST = 64     # columns of a dimension that counts as rare when the first candidates are chosen
GRID_ROWS = 16384  # rows of a block of the row grid
TILE_ROWS = 1024   # query rows of a block multiplied at once
CELLS = 1 << 21    # products of a block of the row grid that a task holds at once
TABLES_BLOCK = 4096    # tables of a block of the row grid
BLOCK_GAIN = 1024  # a multiplication in a block costs about 1/1024 of a meeting in the join
WIDEST = 1 << 16   # dimensions of a vector that blocks hold in full
SURE = 1 - 1e-9    # bounds are taken this much smaller than the score they must beat, for rounding


def blocks_for(n: int, target: int = 4096) -> int:
    return max(1, math.ceil(n / target))


# ---------------------------------------------------------------- sparse path

def with_norms(sparse: DataFrame, ids: list[str]) -> DataFrame:
    """Entries with the norm of their vector; the store's rows have it already."""
    return sparse if "norm" in sparse.columns else sparse.join(sparse_norms(sparse, ids), ids)


def on_dim(left: DataFrame, right: DataFrame, limit: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``dim``.  Lists of more than ``limit``
    right rows are dealt over parts, and the left rows of those dimensions go to
    each part, so no dimension lands in one task.  The list of parts has at most
    one row a dimension of the encoder, whatever the number of columns."""
    limit = limit or HOT_LIST
    parts = (right.groupBy(F.col("dim").alias("hot_dim")).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("parts"))
             .where("parts > 1"))
    parts = cut_lineage(parts)
    of = lambda df: df.join(F.broadcast(parts), F.col("dim") == F.col("hot_dim"), "left").drop("hot_dim")
    one = F.coalesce("parts", F.lit(1))
    ids = [c for c in right.columns if c != "dim"]
    r = of(right).withColumn("part", F.pmod(F.xxhash64(*ids), one).cast("int")).drop("parts")
    l = of(left).withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return l.join(r, ["dim", "part"]).drop("part")


def sparse_cosine(left: DataFrame, right: DataFrame, lid: list[str], rid: list[str],
                  lp: str = "q_", rp: str = "l_", cond=None) -> DataFrame:
    """J1 over sparse vectors: dot / ((|a|+1e-8)(|b|+1e-8)) for pairs with a
    shared dimension (all others have cosine 0).  The norms travel with the
    entries, so the pairs are shuffled once."""
    l = with_norms(left, lid).select(*[F.col(c).alias(lp + c) for c in lid], "dim", F.col("w").alias("_lw"), F.col("norm").alias("_ln"))
    r = with_norms(right, rid).select(*[F.col(c).alias(rp + c) for c in rid], "dim", F.col("w").alias("_rw"), F.col("norm").alias("_rn"))
    j = on_dim(l, r)
    if cond is not None:
        j = j.where(cond)
    return (j.groupBy(*[lp + c for c in lid], *[rp + c for c in rid])
            .agg(F.sum(F.col("_lw") * F.col("_rw")).alias("dot"), F.first("_ln").alias("_ln"), F.first("_rn").alias("_rn"))
            .withColumn("sim", _cosine("dot")).drop("_ln", "_rn"))


def _cosine(dot: str):
    return F.col(dot) / ((F.col("_ln") + F.lit(COS_EPS)) * (F.col("_rn") + F.lit(COS_EPS)))


def column_links_topk(col_emb: DataFrame, k: int = 30) -> DataFrame:
    """J2 + W3 (sparse): for each table pair table1 < table2, the top-k column
    pairs with cosine > 0.  Output (table1, table2, column1, column2, prob, rank)."""
    ids = ["table_id", "col_name"]
    sims = sparse_cosine(col_emb, col_emb, ids, ids, "a_", "b_",
                         cond=F.col("a_table_id") < F.col("b_table_id"))
    sims = sims.where(F.col("sim") > 0).select(
        F.col("a_table_id").alias("table1"), F.col("b_table_id").alias("table2"),
        F.col("a_col_name").alias("column1"), F.col("b_col_name").alias("column2"), F.col("sim").alias("prob"))
    return rank_within(sims, ["table1", "table2"],
                       [F.desc("prob"), F.asc("column1"), F.asc("column2")], k)


def _mean_best(best: DataFrame, n_q: DataFrame) -> DataFrame:
    """A5: (query_id, cand_id, score) from (q_table_id, l_table_id, q_col_name, best).
    The sum runs in column order, so that equal inputs give equal scores."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("q_col_name", "best"))), lambda x: x["best"])
    return (best.groupBy("q_table_id", "l_table_id").agg(F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x).alias("s"))
            .join(n_q, "q_table_id")
            .select(F.col("q_table_id").alias("query_id"), F.col("l_table_id").alias("cand_id"), (F.col("s") / F.col("n_q")).alias("score"))
            .where(F.col("score") > 0))


class ColumnSearch:
    """J3 (A4 -> A5 -> W4) with bounds: per query table the top-k lake tables by
    the mean, over all query key columns, of the best (>= 0) cosine with any key
    column of the lake table.

    1. Seeds: the tables a query meets most on rare dimensions.  The k-th best
       exact score among them is the threshold its result must reach.
    2. A query column's entries are taken by squared weight per column that
       holds the dimension, until the rest has a norm below the threshold.  A
       lake column met on no entry taken has a cosine of at most that rest, and
       a table all of whose columns are so has too low a mean.
    3. For the tables met, the parts of the dot products on the entries taken,
       plus the rest's norm, bound the score; tables that can reach the
       threshold get their exact scores.

    Frequent dimensions (words that stand in every text) are only met for these.
    A query with fewer than ``k`` tables of a positive score has threshold 0 and
    meets all.  ``met``: what the bound left, see :meth:`work`."""

    def __init__(self, q_emb: DataFrame, l_emb: DataFrame, q_keys: DataFrame, k: int = 30, exclude_self: bool = False):
        ids = ["table_id", "col_name"]
        self.k, self.same = k, F.lit(True) if not exclude_self else F.col("q_table_id") != F.col("l_table_id")
        named = lambda e, p, w, n: with_norms(e, ids).select(
            *[F.col(c).alias(p + c) for c in ids], "dim", F.col("w").alias(w), F.col("norm").alias(n))
        self.q, self.l = cut_lineage(named(q_emb, "q_", "_lw", "_ln")), cut_lineage(named(l_emb, "l_", "_rw", "_rn"))
        self.n_q = q_keys.groupBy(F.col("table_id").alias("q_table_id")).agg(F.count(F.lit(1)).alias("n_q"))
        self.df = self.l.groupBy("dim").agg(F.count(F.lit(1)).alias("df"))       # a row a dimension of the encoder
        self.thresholds = cut_lineage(self._thresholds())
        self.candidates, self.met = self._candidates()

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Scores of the given (q_table_id, l_table_id)."""
        dots = (pairs.join(self.q, "q_table_id").join(self.l, ["l_table_id", "dim"])
                .groupBy("q_table_id", "l_table_id", "q_col_name", "l_col_name")
                .agg(F.sum(F.col("_lw") * F.col("_rw")).alias("dot"), F.first("_ln").alias("_ln"), F.first("_rn").alias("_rn")))
        best = (dots.withColumn("sim", _cosine("dot")).groupBy("q_table_id", "l_table_id", "q_col_name")
                .agg(F.greatest(F.max("sim"), F.lit(0.0)).alias("best")))
        return _mean_best(best, self.n_q)

    def _thresholds(self) -> DataFrame:
        """(q_table_id, threshold): the k-th best score of the seeds, 0 with fewer."""
        rare = self.df.where(F.col("df") <= SEED_LIST).select("dim")
        met = (self.q.join(rare, "dim").join(self.l, "dim").where(self.same).groupBy("q_table_id", "l_table_id")
               .agg(F.sum(F.col("_lw") * F.col("_rw") / (F.col("_ln") * F.col("_rn"))).alias("part")))
        seeds = rank_within(met, ["q_table_id"], [F.desc("part"), F.asc("l_table_id")], self.k).select("q_table_id", "l_table_id")
        scores = self.exact(seeds).groupBy(F.col("query_id").alias("q_table_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        return (self.n_q.select("q_table_id").join(scores, "q_table_id", "left")
                .select("q_table_id", F.when(F.col("n") >= self.k, F.col("least")).otherwise(F.lit(0.0)).alias("threshold")))

    def _candidates(self) -> tuple[DataFrame, DataFrame]:
        col = Window.partitionBy("q_table_id", "q_col_name")
        u2 = (F.col("_lw") / F.col("_ln")) * (F.col("_lw") / F.col("_ln"))
        before = col.orderBy(F.desc(u2 / F.col("df")), "dim").rowsBetween(Window.unboundedPreceding, -1)
        taken = (self.q.join(self.thresholds, "q_table_id").join(self.df.withColumnRenamed("dim", "d"), F.col("dim") == F.col("d"), "left")
                 .withColumn("df", F.coalesce("df", F.lit(1))).drop("d").withColumn("u2", u2)
                 .withColumn("left2", F.sum("u2").over(col) - F.coalesce(F.sum("u2").over(before), F.lit(0.0)))
                 .withColumn("taken", F.col("left2") >= F.col("threshold") * F.col("threshold") * (SURE * SURE)))
        taken = taken.withColumn("rest", F.sqrt(F.sum(F.when(~F.col("taken"), F.col("u2")).otherwise(0.0)).over(col)))
        rests = taken.groupBy("q_table_id", "q_col_name").agg(F.first("rest").alias("rest"))
        floor = rests.groupBy("q_table_id").agg(F.sum("rest").alias("floor"))          # no column met: the sum of the rests
        asked = taken.where("taken").select("q_table_id", "q_col_name", "dim", "_lw", "_ln", "rest")
        dot, r2 = F.col("_lw") * F.col("_rw") / (F.col("_ln") * F.col("_rn")), (F.col("_rw") / F.col("_rn")) * (F.col("_rw") / F.col("_rn"))
        part = (on_dim(asked, self.l).where(self.same).groupBy("q_table_id", "q_col_name", "l_table_id", "l_col_name")
                .agg(F.sum(dot).alias("part"), F.first("rest").alias("rest"), F.sum(r2).alias("met2")))
        # what is left of the lake column's unit vector bounds the rest of the product; no cosine is above 1
        most = F.least(F.col("part") + F.col("rest") * F.sqrt(F.greatest(1 - F.col("met2"), F.lit(0.0))), F.lit(1.0))
        part = cut_lineage(part.select("q_table_id", "q_col_name", "l_table_id", "l_col_name", "rest", most.alias("most")))
        gain = (part.groupBy("q_table_id", "l_table_id", "q_col_name").agg(F.greatest(F.max("most"), F.first("rest")).alias("most"), F.first("rest").alias("rest"))
                .groupBy("q_table_id", "l_table_id").agg(F.sum(F.col("most") - F.col("rest")).alias("gain")))
        able = (gain.join(floor, "q_table_id").join(self.n_q, "q_table_id").join(self.thresholds, "q_table_id")
                .where((F.col("gain") + F.col("floor")) / F.col("n_q") >= F.col("threshold") * SURE - 1e-12).select("q_table_id", "l_table_id"))
        return cut_lineage(able), part

    def top(self) -> DataFrame:
        """(query_id, cand_id, score, rank)."""
        return rank_within(self.exact(self.candidates), ["query_id"], [F.desc("score"), F.asc("cand_id")], self.k)

    def work(self) -> DataFrame:
        """(pairs_met, tables_scored, pairs_all): column pairs met on the entries
        taken, table pairs scored exactly, column pairs that share a dimension."""
        every = on_dim(self.q, self.l).where(self.same).select("q_table_id", "q_col_name", "l_table_id", "l_col_name").distinct()
        one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
        return one(self.met, "pairs_met").join(one(self.candidates, "tables_scored")).join(one(every, "pairs_all"))


def table_search_columns(q_emb: DataFrame, l_emb: DataFrame, q_keys: DataFrame, k: int = 30,
                         exclude_self: bool = False, path: str = "auto") -> DataFrame:
    """J3.  ``q_keys`` = (table_id, col_name) of query key columns.  Output
    (query_id, cand_id, score, rank).

    ``path``: ``sparse`` (the top of :class:`ColumnSearch`), ``blocks`` (matrix
    product of blocks) or ``auto``: the cheaper one, counted beforehand.  Dot products
    are exact and sums run in column order on both, so the results are the same."""
    if path == "auto":
        dims = lambda e, n: e.groupBy("dim").agg(F.count(F.lit(1)).alias(n))
        met = dims(q_emb, "a").join(dims(l_emb, "b"), "dim", "full").agg(F.sum(F.col("a") * F.col("b")), F.max("dim")).first()
        columns = [e.select("table_id", "col_name").distinct().count() for e in (q_emb, l_emb)]
        width = int(met[1] or 0) + 1
        path = "blocks" if width <= WIDEST and int(met[0] or 0) * BLOCK_GAIN > columns[0] * columns[1] * width else "sparse"
    if path == "sparse":
        return ColumnSearch(q_emb, l_emb, q_keys, k, exclude_self).top()
    return table_search_columns_blocks(q_emb, l_emb, q_keys, k, exclude_self)


# ----------------------------------------------------------------- dense path

def _fresh(df: DataFrame, cols: list[str]) -> DataFrame:
    """Re-alias columns so both sides of a self co-group have distinct attributes."""
    return df.select(*[F.col(c).alias(c) for c in cols])


def _assign_blocks(df: DataFrame, ids: list[str], own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    return (df.withColumn(own, F.pmod(F.xxhash64(*ids), F.lit(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))


def grid_for(n: int) -> int:
    """Blocks a side of the row grid: of GRID_ROWS rows, since each row is sent to
    every block of the other side; at least 4 where there is work for 16 tasks."""
    return max(blocks_for(n, GRID_ROWS), min(blocks_for(n, 1024), 4))


def row_grid(rows: DataFrame) -> int:
    """Blocks a side of the row grid for ``rows(table_id, ..)``: few enough rows and tables a block."""
    n, tables = rows.agg(F.count(F.lit(1)), F.count_distinct("table_id")).first()
    return max(grid_for(n), blocks_for(tables, TABLES_BLOCK))


def _distinct_rows(rows: DataFrame, packed: bool) -> DataFrame:
    """``(table_id, row_idx, arity, n, vector)``: equal packed rows of a table are one
    row that counts ``n`` times.  Dense rows stay as they are."""
    if not packed:
        return _fresh(rows, ["table_id", "row_idx", "arity", "vec"]).withColumn("n", F.lit(1).cast("long"))
    e = F.array_sort(F.arrays_zip(F.col("dims").alias("d"), F.col("ws").alias("w")))
    return (rows.select("table_id", "row_idx", "arity", e.alias("e"))
            .groupBy("table_id", "arity", "e").agg(F.min("row_idx").alias("row_idx"), F.count_distinct("row_idx").alias("n"))
            .select("table_id", "row_idx", "arity", "n", F.col("e.d").alias("dims"), F.col("e.w").alias("ws")))


def _table_blocks(rows: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Blocks that hold whole tables (``whole``); tables of more than GRID_ROWS / 4
    rows are dealt by row.  The list of those has a row for so many rows at most."""
    most = max(1, GRID_ROWS // 4)
    large = (rows.groupBy(F.col("table_id").alias("large_id")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1"))
    large = F.broadcast(cut_lineage(large))
    return (rows.join(large, F.col("table_id") == F.col("large_id"), "left").withColumn("whole", F.col("parts").isNull())
            .withColumn("at", F.pmod(F.xxhash64("row_idx"), F.coalesce("parts", F.lit(1))))
            .withColumn(own, F.pmod(F.xxhash64("table_id", "at"), F.lit(n_own)).cast("int")).drop("large_id", "parts", "at")
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))


def lake_numbers(l_rows: DataFrame, lake_pos: DataFrame | None = None) -> DataFrame:
    """``(l_table_id, num)``: the tables of ``l_rows`` numbered from 0, in the lake's order
    (position, then id; tables without a position are left out) or else by id."""
    tables = l_rows.select(F.col("table_id").alias("l_table_id")).distinct()
    order = [F.col("l_table_id")]
    if lake_pos is not None:
        pos = lake_pos.groupBy(F.col("table_id").alias("l_table_id")).agg(F.min("table_pos").alias("_pos"))
        tables, order = tables.join(pos, "l_table_id"), [F.col("_pos"), *order]
    return global_index(tables, order, "at").select("l_table_id", F.col("at").cast("int").alias("num"))


def joinability_blocks(q_rows: DataFrame, l_rows: DataFrame, alpha: float, numbers: DataFrame, q_blocks: int = 1, l_blocks: int = 1,
                       exclude_self: bool = True, packed_dim: int | None = None, keep_zero: bool = False, k: int | None = None) -> DataFrame:
    """The block tasks of :func:`joinability_counts`: ``(q_table_id, row_idx, nums, ns)``.
    A row holds the numbers of the lake tables of a block that match a query table, and how many
    rows do; lake tables dealt over several blocks have one for each query row
    (``row_idx``) instead, as their rows' matches overlap.  With ``k`` a query table of one arity that
    lies whole in its block keeps the first k: most rows, then the smallest number.

    Memory of a task: its two blocks, CELLS products, and some bytes a pair of tables
    that match, of TABLES_BLOCK tables a side."""
    keep = ["table_id", "row_idx", "real", "n", "whole"] + (["dims", "ws"] if packed_dim else ["vec"])
    rows = cut_lineage(_distinct_rows(q_rows, packed_dim is not None))
    other = rows if q_rows is l_rows else cut_lineage(_distinct_rows(l_rows, packed_dim is not None))
    flat = lambda df: df.withColumn("real", F.col("row_idx").isNotNull()).withColumn("row_idx", F.coalesce("row_idx", F.lit(0)))
    q = flat(_table_blocks(rows, "qb", "lb", q_blocks, l_blocks))
    if k is not None:
        # the matches of a table with rows of several arities are added up over them: nothing of it is cut
        mixed = rows.groupBy(F.col("table_id").alias("mixed_id")).agg(F.min("arity").alias("_a"), F.max("arity").alias("_z")).where("_a <> _z")
        q = q.join(mixed, F.col("table_id") == F.col("mixed_id"), "left").withColumn("whole", F.col("whole") & F.col("mixed_id").isNull())
    q = _fresh(q, [*keep, "arity", "qb", "lb"])
    l = _table_blocks(other, "lb", "qb", l_blocks, q_blocks).join(numbers, F.col("table_id").eqNullSafe(F.col("l_table_id")))
    l = _fresh(l, ["table_id", "num", "whole", "arity", *keep[5:], "lb", "qb"])
    # self-contained closure (numpy / pyarrow only): shipped by value to workers
    eps, cells, tile, pdim = NORM_EPS, CELLS, TILE_ROWS, packed_dim

    def fn(key: tuple, qt: pa.Table, lt: pa.Table) -> pa.Table:
        def _list(t, c):
            col = t[c].combine_chunks()
            col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
            return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())

        def _distinct(t):
            """The distinct vectors and each row's place among them."""
            if pdim is None:
                values, _ = _list(t, "vec")
                m = values.astype(np.float64).reshape(t.num_rows, -1)
            else:
                (dims, size), (ws, _) = _list(t, "dims"), _list(t, "ws")
                end = np.cumsum(size)
            seen, at, first = {}, np.empty(t.num_rows, dtype=np.int64), []
            for i in range(t.num_rows):
                own = m[i].tobytes() if pdim is None else (dims[end[i] - size[i]:end[i]].tobytes(), ws[end[i] - size[i]:end[i]].tobytes())
                at[i] = seen.setdefault(own, len(first))
                if at[i] == len(first):
                    first.append(i)
            first = np.array(first, dtype=np.int64)
            if pdim is None:
                return (lambda of: m[first[of]]), len(first), at
            width = int(key[2].as_py()) * pdim

            def some(of):
                of = first[of]
                out = np.zeros((len(of), width))
                n = size[of]
                pick = np.repeat(end[of] - n - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                out[np.repeat(np.arange(len(of)), n), dims[pick]] = ws[pick]
                return out
            return some, len(first), at

        def _norms(m):
            sums = [(x * x).sum(axis=1) for x in (m[i:i + 1024] for i in range(0, len(m), 1024))]
            return np.maximum(np.sqrt(np.concatenate(sums)), eps)

        def _starts(*cols):
            new = np.zeros(len(cols[0]), dtype=bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        names, ids, sizes, nums, ns = [], [], [], [], []

        def _add(table, row, num, n):
            names.append(table)
            ids.append(row)
            sizes.append(len(num))
            nums.append(num.astype(np.int32))
            ns.append(n.astype(np.int64))

        if qt.num_rows and lt.num_rows:
            lt = lt.take(pa.compute.sort_indices(lt["num"]))
            l_num = lt["num"].to_numpy()
            starts = _starts(l_num)
            l_nums, l_whole = l_num[starts], lt["whole"].to_numpy()[starts]
            place = dict(zip(lt["table_id"].take(pa.array(starts)).to_pylist(), range(len(starts))))
            some, n_vec, l_at = _distinct(lt)
            L = some(np.arange(n_vec))
            nl = _norms(L)
            l_flat = None if n_vec == len(l_at) else l_at
            qt = qt.take(pa.compute.sort_indices(qt, sort_keys=[("table_id", "ascending"), ("row_idx", "ascending")]))
            coded = pa.compute.dictionary_encode(qt["table_id"].combine_chunks(), null_encoding="encode")
            coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
            q_names, q_table = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            q_row, q_n, q_real, q_whole = (qt[c].to_numpy() for c in ("row_idx", "n", "real", "whole"))
            own_of = np.array([place.get(x, -1) for x in q_names])
            some, _, q_at = _distinct(qt)
            met = np.ones(len(starts), dtype=bool)

            def _close(table, total):
                """What a query table has in this block."""
                own = own_of[table]
                if keep_zero:                      # one entry a table pair met, also those without a match
                    ok = met.copy()
                    if exclude_self and own >= 0:
                        ok[own] = False
                    ok, total = np.flatnonzero(ok), np.where(l_whole, total, 0)
                else:
                    ok = np.flatnonzero(l_whole & (total > 0))
                    if k is not None and len(ok) > k and not split[table]:
                        ok = np.sort(ok[np.argsort(-total[ok], kind="stable")[:k]])
                if len(ok):
                    _add(q_names[table], None, l_nums[ok], total[ok])

            split = np.ones(len(q_names), dtype=bool)
            split[q_table[q_whole]] = False
            rows = max(1, min(tile, cells // len(l_num)))
            held, total, table = None, None, None         # the last row id and table of the tile before: they may go on
            for a in range(0, qt.num_rows, rows):
                z = min(a + rows, qt.num_rows)
                here, of = np.unique(q_at[a:z], return_inverse=True)
                Q = some(here)
                sim = Q @ L.T
                sim /= np.outer(_norms(Q), nl)
                hit = sim > alpha
                if l_flat is not None:
                    hit = hit[:, l_flat]
                hit = np.logical_or.reduceat(hit, starts, axis=1)[of]          # [rows, lake tables]
                hit &= q_real[a:z, None]
                t, r, n = q_table[a:z], q_row[a:z], q_n[a:z]
                if exclude_self:
                    own = own_of[t]
                    hit[np.flatnonzero(own >= 0), own[own >= 0]] = False
                if held is not None:
                    hit, t, r, n = np.concatenate([held[0], hit]), np.r_[held[1], t], np.r_[held[2], r], np.r_[held[3], n]
                first = _starts(t, r)                     # rows of one id count once, if any of them matches
                hit, t, r, n = np.logical_or.reduceat(hit, first, axis=0), t[first], r[first], n[first]
                if z < qt.num_rows:
                    held, hit, t, r, n = (hit[-1:], t[-1:], r[-1:], n[-1:]), hit[:-1], t[:-1], r[:-1], n[:-1]
                if not len(t):
                    continue
                dealt = np.flatnonzero(~l_whole)
                if len(dealt):
                    for i in np.flatnonzero(hit[:, dealt].any(axis=1)):
                        c = dealt[hit[i, dealt]]
                        _add(q_names[t[i]], r[i], l_nums[c], np.full(len(c), n[i]))
                first = _starts(t)
                sums = np.add.reduceat(hit * n[:, None], first, axis=0)
                for own, row in zip(t[first], sums):
                    if table is not None and own != table:
                        _close(table, total)
                        total = None
                    table, total = own, row if total is None else total + row
            _close(table, total)
        ends = pa.array(np.r_[0, np.cumsum(sizes, dtype=np.int64)].astype(np.int32))
        flat = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind))
        return pa.table({"q_table_id": pa.array(names, pa.string()), "row_idx": pa.array(ids, pa.int64()),
                         "nums": flat(nums, pa.int32()), "ns": flat(ns, pa.int64())})

    return (q.groupBy("qb", "lb", "arity").cogroup(l.groupBy("qb", "lb", "arity"))
            .applyInArrow(fn, "q_table_id string, row_idx long, nums array<int>, ns array<long>"))


def joinability_counts(q_rows: DataFrame, l_rows: DataFrame, alpha: float,
                       q_blocks: int = 1, l_blocks: int = 1, exclude_self: bool = True,
                       packed_dim: int | None = None, keep_zero: bool = True, best: tuple[int, DataFrame] | None = None) -> DataFrame:
    """J4 core + A6 (dense block path): for each (query table, lake table) of equal
    key arity, the number of query rows with some lake row of cosine > alpha.

    Inputs ``(table_id, row_idx, arity, vec)``; cosine = dot / (max(|q|,eps)
    max(|l|,eps)), i.e. the dot product of unit-normalised rows (E4/E5) with
    the division done last, so integer-valued vectors give exact dots.
    Output ``(q_table_id, l_table_id, n_match)`` for every table pair met, or
    without ``keep_zero`` for those with a match only (no row a table pair leaves
    a task then).  ``best`` = (k, lake_pos): all that the first k of each ranking need.

    Equal packed rows of a table are compared once.  A lake table that lies whole
    in its block leaves a task as one count a query table; only tables dealt over
    several blocks leave it row by row, as their rows' matches overlap."""
    numbers = lake_numbers(l_rows, best[1] if best else None)
    found = joinability_blocks(q_rows, l_rows, alpha, numbers, q_blocks, l_blocks, exclude_self, packed_dim, keep_zero, best[0] if best else None)
    return counts_of(found).join(numbers, "num").select("q_table_id", "l_table_id", "n_match")


def counts_of(found: DataFrame) -> DataFrame:
    """``(q_table_id, num, n_match)`` from the rows of :func:`joinability_blocks`."""
    pair = ["q_table_id", "num"]
    pairs = found.select("q_table_id", "row_idx", F.inline(F.arrays_zip(F.col("nums").alias("num"), F.col("ns").alias("n"))))
    return (pairs.groupBy(*pair, "row_idx").agg(F.when(F.col("row_idx").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"))
            .groupBy(*pair).agg(F.sum("n").alias("n_match")))


def joinability_scores(q_rows: DataFrame, l_rows: DataFrame, alpha: float = 0.7,
                       q_blocks: int | None = None, l_blocks: int | None = None, exclude_self: bool = True,
                       packed_dim: int | None = None) -> DataFrame:
    """Share of query rows with a lake row of cosine > alpha (strict).
    Block counts follow the number of rows unless given."""
    q_blocks = q_blocks or row_grid(q_rows)
    l_blocks = l_blocks or (q_blocks if l_rows is q_rows else row_grid(l_rows))
    counts = joinability_counts(q_rows, l_rows, alpha, q_blocks, l_blocks, exclude_self, packed_dim)
    nq = q_rows.groupBy(F.col("table_id").alias("q_table_id")).agg(F.count(F.lit(1)).alias("n_q"))
    return (counts.join(nq, "q_table_id")
            .select(F.col("q_table_id").alias("query_id"), F.col("l_table_id").alias("cand_id"),
                    (F.col("n_match") / F.col("n_q")).alias("score"), "n_match", "n_q"))


def table_search_rows(scores: DataFrame, lake_pos: DataFrame) -> DataFrame:
    """J5 + W5: full ranking per query, score desc, ties in lake order.
    ``lake_pos`` = (table_id, table_pos)."""
    pos = lake_pos.select(F.col("table_id").alias("cand_id"), F.col("table_pos").alias("lake_pos"))
    s = scores.join(pos, "cand_id")
    return rank_within(s, ["query_id"], [F.desc("score"), F.asc("lake_pos"), F.asc("cand_id")])


def table_search_columns_dense(q_vecs: DataFrame, l_vecs: DataFrame, q_keys: DataFrame, k: int = 30, exclude_self: bool = False,
                               q_blocks: int | None = None, l_blocks: int | None = None) -> DataFrame:
    """J3 for dense vectors ``(table_id, col_name, vec)``, e.g. of a plug-in encoder.
    Blocks hold whole tables, so a task has every column of its table pairs and
    returns its k best per query; no row per table pair leaves it."""
    n_q = q_keys.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_q"))
    q_blocks = q_blocks or grid_for(q_vecs.count())
    l_blocks = l_blocks or grid_for(l_vecs.count())
    cols = ["table_id", "col_name", "vec"]
    q = _assign_blocks(_fresh(q_vecs, cols).join(n_q, "table_id"), ["table_id"], "qb", "lb", q_blocks, l_blocks)
    l = _assign_blocks(_fresh(l_vecs, cols), ["table_id"], "lb", "qb", l_blocks, q_blocks)
    eps, cells = COS_EPS, CELLS

    def fn(qp: pd.DataFrame, lp: pd.DataFrame) -> pd.DataFrame:
        def _matrix(p):
            m = np.stack([np.asarray(x, dtype=np.float64) for x in p["vec"]])
            return m, np.sqrt((m * m).sum(axis=1)) + eps

        def _starts(t):
            return np.flatnonzero(np.r_[True, t[1:] != t[:-1]])

        none = pd.DataFrame({"query_id": pd.Series(dtype=object), "cand_id": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if qp.empty or lp.empty:
            return none
        qp = qp.sort_values(["table_id", "col_name"], kind="stable")
        lp = lp.sort_values("table_id", kind="stable")
        lt, qt, n_q = lp["table_id"].to_numpy(), qp["table_id"].to_numpy(), qp["n_q"].to_numpy()
        L, nl = _matrix(lp)
        l_at, q_at = _starts(lt), np.r_[_starts(qt), len(qt)]
        names, place = lt[l_at], {t: i for i, t in enumerate(lt[l_at])}
        tile, out, a = max(1, cells // len(L)), [none], 0
        while a < len(q_at) - 1:                         # query tables whose columns fill a tile
            z = max(a + 1, int(np.searchsorted(q_at, q_at[a] + tile, side="right")) - 1)
            Q, nq = _matrix(qp.iloc[q_at[a]:q_at[z]])
            sim = Q @ L.T
            sim /= np.outer(nq, nl)
            best = np.maximum(np.maximum.reduceat(sim, l_at, axis=1), 0.0)
            first, columns = q_at[a:z] - q_at[a], np.diff(q_at[a:z + 1])
            total = np.zeros((z - a, len(names)))
            for nth in range(columns.max()):             # in column order, as the sparse path adds
                more = np.flatnonzero(columns > nth)
                total[more] += best[first[more] + nth]
            total /= n_q[q_at[a:z]][:, None]
            for row, table in zip(total, qt[q_at[a:z]]):
                if exclude_self and table in place:
                    row[place[table]] = 0.0
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else 0.0
                ok = np.flatnonzero((row >= least) & (row > 0))
                top = ok[np.argsort(-row[ok], kind="stable")][:k]          # names are sorted: ties go to the smaller
                out.append(pd.DataFrame({"query_id": table, "cand_id": names[top], "score": row[top]}))
            a = z
        return pd.concat(out, ignore_index=True)

    found = (q.groupBy("qb", "lb").cogroup(l.groupBy("qb", "lb")).applyInPandas(fn, "query_id string, cand_id string, score double"))
    return rank_within(found, ["query_id"], [F.desc("score"), F.asc("cand_id")], k)


def _packed_columns(emb: DataFrame) -> DataFrame:
    """``(table_id, col_name, dims, ws)``: the entries of a column in one row."""
    ids = ["table_id", "col_name"]
    e = emb.where("table_id IS NOT NULL AND col_name IS NOT NULL").groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct(F.col("dim").cast("int").alias("d"), F.col("w").cast("double").alias("w")))).alias("e"))
    return e.select(*ids, F.col("e.d").alias("dims"), F.col("e.w").alias("ws"))


def table_search_columns_blocks(q_emb: DataFrame, l_emb: DataFrame, q_keys: DataFrame, k: int = 30, exclude_self: bool = False,
                                q_blocks: int | None = None, l_blocks: int | None = None) -> DataFrame:
    """J3 for sparse vectors ``(table_id, col_name, dim, w)`` by blocks of whole
    tables.  Columns travel as their entries; equal columns of a block are multiplied
    once; a task returns its k best tables a query table.  Memory of a task: its lake
    block in full (at most 2^24 numbers) and a tile of products."""
    n_q = q_keys.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_q"))
    q = cut_lineage(_packed_columns(q_emb).join(n_q, "table_id"))
    l = cut_lineage(_packed_columns(l_emb))
    sizes = [df.agg(F.count(F.lit(1)), F.max(F.array_max("dims"))).first() for df in (q, l)]
    width = max(int(x[1] or 0) for x in sizes) + 1
    blocks = lambda n: max(grid_for(n), blocks_for(n, max(1, (1 << 24) // width)))
    q_blocks, l_blocks = q_blocks or blocks(sizes[0][0]), l_blocks or blocks(sizes[1][0])
    q = _assign_blocks(_fresh(q, [*q.columns]), ["table_id"], "qb", "lb", q_blocks, l_blocks)
    l = _assign_blocks(_fresh(l, [*l.columns]), ["table_id"], "lb", "qb", l_blocks, q_blocks)
    eps, tile = COS_EPS, TILE_ROWS

    def fn(qp: pd.DataFrame, lp: pd.DataFrame) -> pd.DataFrame:
        def _starts(t):
            return np.flatnonzero(np.r_[True, t[1:] != t[:-1]])

        def _matrix(p):
            """The distinct vectors, their norms, and each row's place among them."""
            seen, at, rows = {}, np.empty(len(p), dtype=np.int64), []
            for i, (d, w) in enumerate(zip(p["dims"], p["ws"])):
                d, w = np.asarray(d, dtype=np.int64), np.asarray(w, dtype=np.float64)
                at[i] = seen.setdefault(d.tobytes() + w.tobytes(), len(rows))
                if at[i] == len(rows):
                    rows.append((d, w))
            m = np.zeros((len(rows), width))
            for i, (d, w) in enumerate(rows):
                m[i, d] = w
            return m, np.sqrt((m * m).sum(axis=1)) + eps, at

        none = pd.DataFrame({"query_id": pd.Series(dtype=object), "cand_id": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if qp.empty or lp.empty:
            return none
        qp = qp.sort_values(["table_id", "col_name"], kind="stable")
        lp = lp.sort_values("table_id", kind="stable")
        qt, lt, n_q = qp["table_id"].to_numpy(), lp["table_id"].to_numpy(), qp["n_q"].to_numpy()
        L, nl, l_at = _matrix(lp)
        l_start, q_start = _starts(lt), np.r_[_starts(qt), len(qt)]
        names, place = lt[l_start], {t: i for i, t in enumerate(lt[l_start])}
        out, a = [none], 0
        while a < len(q_start) - 1:                      # query tables whose columns fill a tile
            z = max(a + 1, int(np.searchsorted(q_start, q_start[a] + tile, side="right")) - 1)
            lo, hi = q_start[a], q_start[z]
            Q, nq, q_at = _matrix(qp.iloc[lo:hi])
            sim = Q @ L.T
            sim /= np.outer(nq, nl)
            best = np.maximum(np.maximum.reduceat(sim[:, l_at], l_start, axis=1), 0.0)
            first, columns = q_start[a:z] - lo, np.diff(q_start[a:z + 1])
            total = np.zeros((z - a, len(names)))
            for nth in range(columns.max()):             # in column order, as the sparse path adds
                more = np.flatnonzero(columns > nth)
                total[more] += best[q_at[first[more] + nth]]
            total /= n_q[q_start[a:z]][:, None]
            for row, table in zip(total, qt[q_start[a:z]]):
                if exclude_self and table in place:
                    row[place[table]] = 0.0
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else 0.0
                ok = np.flatnonzero((row >= least) & (row > 0))
                top = ok[np.argsort(-row[ok], kind="stable")][:k]          # names are sorted: ties go to the smaller
                out.append(pd.DataFrame({"query_id": table, "cand_id": names[top], "score": row[top]}))
            a = z
        return pd.concat(out, ignore_index=True)

    found = (q.groupBy("qb", "lb").cogroup(l.groupBy("qb", "lb")).applyInPandas(fn, "query_id string, cand_id string, score double"))
    return rank_within(found, ["query_id"], [F.desc("score"), F.asc("cand_id")], k)


def column_links_topk_dense(col_vecs: DataFrame, k: int = 30, blocks: int = 1) -> DataFrame:
    """J2 + W3 (dense block path): ``(table_id, col_name, vec)`` -> same output
    as :func:`column_links_topk`.  Block pairs (i <= j) only; each task emits
    its local top-k per table pair before the final window."""
    cols = ["table_id", "col_name", "vec"]
    a = (_fresh(col_vecs, cols).withColumn("ab", F.pmod(F.xxhash64("table_id", "col_name"), F.lit(blocks)).cast("int"))
         .withColumn("bb", F.explode(F.sequence(F.col("ab"), F.lit(blocks - 1)))))
    b = (_fresh(col_vecs, cols).withColumn("bb", F.pmod(F.xxhash64("table_id", "col_name"), F.lit(blocks)).cast("int"))
         .withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("bb")))))
    schema = "table1 string, table2 string, column1 string, column2 string, prob double"
    eps = COS_EPS

    def fn(ap: pd.DataFrame, bp: pd.DataFrame) -> pd.DataFrame:
        def _stack(v):
            return np.stack([np.asarray(x, dtype=np.float64) for x in v])

        cols = ["table1", "table2", "column1", "column2", "prob"]
        if ap.empty or bp.empty:
            return pd.DataFrame({c: [] for c in cols})
        A, B = _stack(ap["vec"].to_numpy()), _stack(bp["vec"].to_numpy())
        na = np.linalg.norm(A, axis=1) + eps
        nb = np.linalg.norm(B, axis=1) + eps
        sim = (A @ B.T) / np.outer(na, nb)
        diagonal = int(ap["ab"].iloc[0]) == int(bp["bb"].iloc[0])
        ta, tb = ap["table_id"].to_numpy(), bp["table_id"].to_numpy()
        ca, cb = ap["col_name"].to_numpy(), bp["col_name"].to_numpy()
        lt = ta[:, None] < tb[None, :]
        gt = ta[:, None] > tb[None, :]
        mask = (lt if diagonal else (lt | gt)) & (sim > 0)
        i, j = np.nonzero(mask)
        swap = ta[i] > tb[j]
        t1 = np.where(swap, tb[j], ta[i]); t2 = np.where(swap, ta[i], tb[j])
        c1 = np.where(swap, cb[j], ca[i]); c2 = np.where(swap, ca[i], cb[j])
        out = pd.DataFrame({"table1": t1, "table2": t2, "column1": c1, "column2": c2, "prob": sim[i, j]})
        out = out.sort_values(["table1", "table2", "prob", "column1", "column2"],
                              ascending=[True, True, False, True, True], kind="stable")
        return out.groupby(["table1", "table2"], sort=False).head(k)

    pairs = (a.groupBy("ab", "bb").cogroup(b.groupBy("ab", "bb")).applyInPandas(fn, schema))
    return rank_within(pairs, ["table1", "table2"], [F.desc("prob"), F.asc("column1"), F.asc("column2")], k)
