"""Centroid clustering with a vantage-point tree over the centroids.

Each round builds the tree on the driver, broadcasts it, and assigns every
vector by a best-first branch-and-bound search of its own: a vector visits the
open node with the smallest lower bound first, and a node is left out only if
its bound lies beyond the best distance so far.  The radius is inclusive, so a
centroid at the same distance is always met, and the smaller number wins.
Distances at vantage points and leaves are exact integers; the bounds, taken
from their roots, are widened by more than their rounding error.  The search
runs for a block of vectors at a time in numpy, each with its own open nodes.

Tasks return sums and counts per centroid; Spark adds them up as decimals.  The
broadcast and what returns to the driver hold ``k * dim`` numbers, at most
MAX_CENTROID_CELLS, whatever the number of vectors.

Edge cases: vectors that are null, of another length, or that hold null or
non-finite components take no part; a row without id is a vector like others
but starts no centroid; with repeated ids the smaller vector comes first; fewer
than ``k`` vectors with an id start fewer centroids, none: no rows; an empty
centroid stays; components of 2^27 or more raise an error (their squared
distances leave 64 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, vectors

LEAF = 4                       # centroids of a leaf
BLOCK_CELLS = 1 << 21          # vectors searched at a time x (tree nodes + components)
MAX_CENTROID_CELLS = 1 << 25   # k * dim, 256 MB
SLACK = 1e-12                  # relative; the roots are exact to about 2e-16


@dataclass
class Tree:
    """Nodes in preorder.  ``points[t]``: the centroids tested at node t (the
    vantage point alone, or a leaf's).  ``kids[t]``: (child, least, greatest
    distance of its centroids from the vantage point)."""
    centroids: np.ndarray
    points: list[list[int]]
    kids: list[list[tuple[int, float, float]]]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def build(centroids: np.ndarray) -> Tree:
    """Median splits by distance from the vantage point, the smallest number."""
    tree = Tree(centroids, [], [])
    todo = [(list(range(len(centroids))), None, 0.0, 0.0)]
    while todo:
        members, parent, lo, hi = todo.pop()
        t = len(tree.points)
        tree.kids.append([])
        if parent is not None:
            tree.kids[parent].append((t, lo, hi))
        if len(members) <= LEAF:
            tree.points.append(members)
            continue
        vantage, rest = members[0], np.array(members[1:])
        tree.points.append([vantage])
        dist = np.sqrt(squared(centroids[rest], centroids[vantage]).astype(np.float64))
        order = np.argsort(dist, kind="stable")
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            todo.append((sorted(rest[part].tolist()), t, float(dist[part].min()), float(dist[part].max())))
    return tree


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row of ``x``, and how many
    distances were computed."""
    n, k = len(x), len(tree.centroids)
    best, arg, tested = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64), 0
    opened = np.full((n, len(tree.points)), np.inf)
    opened[:, 0] = 0
    live = np.arange(n)
    while len(live):
        node = opened[live].argmin(1)
        bound = opened[live, node]
        go = (bound <= np.sqrt(best[live].astype(np.float64)) * (1 + SLACK)) & np.isfinite(bound)   # inclusive
        live, node, bound = live[go], node[go], bound[go]
        opened[live, node] = np.inf
        for t in np.unique(node):
            here = node == t
            rows = live[here]
            for c in tree.points[t]:
                d2 = squared(x[rows], tree.centroids[c])
                tested += len(rows)
                better = (d2 < best[rows]) | ((d2 == best[rows]) & (c < arg[rows]))
                best[rows[better]], arg[rows[better]] = d2[better], c
            if tree.kids[t]:
                d = np.sqrt(d2.astype(np.float64))
                for child, lo, hi in tree.kids[t]:
                    low = np.maximum(d - hi, lo - d) - SLACK * (d + hi)
                    opened[rows, child] = np.maximum(np.maximum(low, 0), bound[here])
    return arg, best, tested


def _blocks(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    dim = tree.centroids.shape[1]
    rows = max(1, BLOCK_CELLS // (len(tree.points) + dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            x = vectors.matrix(part.column("v"), dim)
            yield part, x, *nearest(tree, x)[:2]


def _sums(rows: DataFrame, tree) -> DataFrame:
    """(cluster, n, sums) of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tree.value.centroids
        n, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
        for _, x, arg, _ in _blocks(batches, tree.value):
            for j in np.unique(arg):
                n[j] += np.count_nonzero(arg == j)
                sums[j] += x[arg == j].sum(0)
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(n[got]), pa.array(list(sums[got]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    return rows.select("v").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dim: int = 64, rounds: int = 3, scale: int = 64) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of
    each vector after ``rounds`` rounds and a last assignment."""
    if k * dim > MAX_CENTROID_CELLS:
        raise ValueError(f"k * dim is limited to {MAX_CENTROID_CELLS}: the centroids are broadcast")
    spark = df.sparkSession
    rows = shared.staged(df.filter(vectors.valid(vec_col) & (F.size(vec_col) == dim))
                         .select(F.col(id_col).alias("id"), vectors.whole(vec_col, scale).alias("v")))
    vectors.check_range(rows)
    start = (rows.filter("id is not null").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "v").limit(k).collect())
    c = np.array([r["v"] for r in start], np.int64).reshape(len(start), dim)
    out = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, cluster int, distance bigint"
    if not len(c):
        return spark.createDataFrame([], out + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    exact = "decimal(38,0)"
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(build(c))
        got = (_sums(rows, tree).select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
               .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s")).collect())        # k * dim rows
        tree.unpersist()
        for r in got:
            c[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    tree = spark.sparkContext.broadcast(build(c))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, arg, best in _blocks(batches, tree.value):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(arg.astype(np.int32)), pa.array(best)], names=[id_col, "cluster", "distance"])

    done = shared.staged(rows.mapInArrow(assign, out))
    tree.unpersist()
    inertia = {r["cluster"]: int(r["s"]) for r in
               done.groupBy("cluster").agg(F.sum(F.col("distance").cast(exact)).alias("s")).collect()}   # k rows
    per = spark.createDataFrame([(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest())
                                 for j, s in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(per), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
