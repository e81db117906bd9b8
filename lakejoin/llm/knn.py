"""Exact top-k by inner product: a Voronoi kNN join.

* Vectors are grouped by their nearest pivot.  Per group the summaries are the
  largest distance to the pivot and the K + 1 smallest.  With |x - p| = d,
  q.p - |q| d <= q.x <= q.p + |q| d.
* The stored smallest distances give each query a lower bound of its K-th best
  score; from it follows how far from pivot j a vector must lie to matter.  The
  minimum over a group of queries is the group's bound for cell j.
* A vector is replicated only to the query groups whose bound it meets.
* Each query group solves locally, in blocks of queries and data of bounded
  size; the K best of the blocks are merged.

Equal vectors: of each distinct vector only the K + 1 smallest ids can be in an
answer (one may be the query's own), so others are left out before the join.

Edge cases: null vectors and those with null or non-finite components, and rows
without id, take no part; shorter vectors are zero-padded; fewer than K
candidates give fewer rows; repeated rows of an id are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.llm import shared

PIVOTS = 64
GROUPS = 8              # query groups: the nearest of the first GROUPS pivots
BLOCK = 16384           # data rows of a block
QUERIES = 1024          # query rows of a block


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of valid vectors."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~bad)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row, pos] = flat
    return out


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2 ** 53:
        return np.rint(q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def top_k(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) for ``queries`` and ``data``, both (id, v)."""
    spark = data.sparkSession
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    data = shared.staged(data.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("id", "v"))
    queries = shared.staged(queries.distinct())
    dim = data.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).unionByName(
        queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0)))).agg(F.max("coalesce(max(size(v)), 0)")).first()[0]
    rows = data.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()          # PIVOTS rows
    pivots = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        pivots[i, :len(r["v"])] = r["v"]
    n_pivots = len(rows)
    if not n_pivots:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    piv = spark.sparkContext.broadcast(pivots)

    def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        # from differences, pivot by pivot: squares of large vectors that lie close together cancel
        return np.stack([np.sqrt(np.einsum("ij,ij->i", x - row, x - row)) for row in p], 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch.column("v"), dim), piv.value)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                names=["id", "v", "cell", "dist"])

    cells = shared.staged(data.mapInArrow(assign, "id long, v array<bigint>, cell int, dist double"))
    near = (cells.select("cell", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist")).alias("nth"))
            .filter(F.col("nth") <= k + 1).select("cell", "dist").collect())     # PIVOTS x (k + 1) rows
    near_cell = np.array([r["cell"] for r in near])
    near_dist = np.array([r["dist"] for r in near])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = piv.value
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            norm = np.sqrt((q * q).sum(1))
            dots = q @ p.T
            slack = 1e-9 * (1 + np.abs(dots).max(initial=0) + norm.max(initial=0) * near_dist.max(initial=0))
            low = dots[:, near_cell] - norm[:, None] * near_dist[None, :]
            if low.shape[1] > k:
                theta = -np.partition(-low, k, axis=1)[:, k] - slack          # the query itself may be among them
            else:
                theta = np.full(len(q), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (theta[:, None] - dots - slack) / norm[:, None]
            need = np.where(norm[:, None] > 0, need, -np.inf)
            group = distances(q, p[:GROUPS]).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(group.astype(np.int32)), pa.array(list(need), pa.list_(pa.float64()))],
                names=["id", "v", "grp", "need"])

    asked = shared.staged(queries.mapInArrow(bounds, "id long, v array<bigint>, grp int, need array<double>"))
    per_group = (asked.groupBy("grp").agg(F.count("*").alias("n"), *[F.min(F.col("need")[j]).alias(f"m{j}") for j in range(n_pivots)])
                 .collect())                                                    # GROUPS rows
    least = {r["grp"]: np.array([r[f"m{j}"] for j in range(n_pivots)]) for r in per_group}
    q_blocks = {r["grp"]: -(-r["n"] // QUERIES) for r in per_group}
    n_data = cells.count()
    d_blocks = max(1, -(-n_data // BLOCK))
    plan = spark.sparkContext.broadcast((least, q_blocks))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, q_blocks = plan.value
        for batch in batches:
            cell, dist = batch.column("cell").to_numpy(), batch.column("dist").to_numpy()
            for g in least:
                take = pa.array(np.flatnonzero(dist >= least[g][cell]))
                part = batch.take(take)
                for b in range(q_blocks[g]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(take), g, np.int32)), pa.array(np.full(len(take), b, np.int32)),
                         part.column("id"), part.column("v")], names=["grp", "qb", "id", "v"])

    part_of = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(d_blocks)).cast("int")
    sent = cells.mapInArrow(replicate, "grp int, qb int, id long, v array<bigint>").withColumn("db", part_of)
    size = F.create_map(*[F.lit(x) for g, b in q_blocks.items() for x in (g, b)]) if q_blocks else F.lit(None)
    if not q_blocks:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    posed = (asked.select("grp", F.pmod(F.xxhash64("id", F.lit(6)), size[F.col("grp")]).cast("int").alias("qb"), "id", "v")
             .withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)))))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(q) or not len(x):
            return empty
        pad = lambda col: np.array([np.pad(np.asarray(v, np.int64), (0, dim - len(v))) for v in col]).reshape(len(col), dim)
        ids = x["id"].to_numpy()
        xs = pad(x["v"])
        out = []
        for lo in range(0, len(q), 256):
            part = q.iloc[lo:lo + 256]
            scores = _exact_scores(pad(part["v"]), xs)
            for qid, s in zip(part["id"].to_numpy(), scores):
                ok = np.flatnonzero(ids != qid)
                if len(ok) > k:
                    kth = -np.partition(-s[ok], k - 1)[k - 1]
                    ok = ok[s[ok] >= kth]
                best = ok[np.lexsort((ids[ok], -s[ok]))][:k]
                out.append(pd.DataFrame({"query_id": qid, "id": ids[best], "score": s[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ["grp", "qb", "db"]
    found = (posed.groupBy(*keys).cogroup(sent.groupBy(*keys))
             .applyInPandas(solve, "query_id long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
