"""Vector code compression with memoised grid cells.

Vectors are cut into equal parts; each part is coded by the nearest entry of its
position's codebook (squared Euclidean distance, ties to the lower index).

A part lies in a coarse cell of a grid.  Entry e is dominated in a cell if some
other entry's greatest distance to the cell's box is less than e's least: it is
nearest for no part there, ties included.  The entries that are left are found
once a cell, kept in a table (task by task) under the cell's hash, and only they are
measured exactly.  The table is emptied when it holds MAX_CELLS cells; that costs
time, not results.  Distances are integers throughout.

Codebooks are refined by rounds of assignment and floor(sum / count); tasks
return sums and counts per entry and Spark adds them up.  The broadcast and what
returns to the driver hold ``entries * dim`` numbers, whatever the number of
vectors.

Edge cases: null vectors and those with null or non-finite components are left
out.  The vector with the smallest id sets the dimension, a multiple of
``parts`` (else an error); a vector of another length keeps its row with null
code and error, which adds nothing to its label's error.  A row without id is
coded but starts no entry; with repeated ids the smaller vector comes first;
fewer ids than entries start fewer entries, no id at all codes nothing.
Components of 2^27 or more raise an error.  Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, vectors

CELLS = 8                      # grid cells across a codebook's range
MAX_CELLS = 1 << 14            # cells remembered per part and task
BLOCK = 2048                   # vectors coded at a time
MAX_ENTRIES = 256              # two hex digits


class Grid:
    """Codebook of one part, (entries, m), with the memoised cells."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.width = max(1, int(entries.max() - entries.min()) // CELLS) if entries.size else 1
        self.cells: dict[bytes, np.ndarray] = {}
        self.measured = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across each cell's box, in ascending order."""
        lo = (cells * self.width)[:, None, :]
        hi = lo + self.width - 1
        e = self.entries[None, :, :]
        near = np.maximum(np.maximum(lo - e, e - hi), 0)
        far = np.maximum(np.abs(e - lo), np.abs(e - hi))
        least, most = (near * near).sum(2), (far * far).sum(2)
        return [np.flatnonzero(row) for row in least <= most.min(1)[:, None]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        cells, of = np.unique(x // self.width, axis=0, return_inverse=True)
        of = of.reshape(-1)
        keys = [row.tobytes() for row in cells]
        if len(self.cells) + len(keys) > MAX_CELLS:
            self.cells.clear()
        new = [i for i, key in enumerate(keys) if key not in self.cells]
        for at in range(0, len(new), 256):
            some = new[at:at + 256]
            for i, found in zip(some, self.candidates(cells[some])):
                self.cells[keys[i]] = found
        lists = [self.cells[key] for key in keys]
        size = np.array([len(c) for c in lists])
        table = np.zeros((len(lists), int(size.max(initial=1))), np.int64)
        for i, c in enumerate(lists):
            table[i, :len(c)] = c
        index, there = table[of], np.arange(table.shape[1])[None, :] < size[of][:, None]
        self.measured += int(there.sum())
        diff = x[:, None, :] - self.entries[index]
        dist = np.where(there, (diff * diff).sum(2), np.iinfo(np.int64).max)
        first = dist.argmin(1)
        row = np.arange(len(x))
        return index[row, first], dist[row, first]


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, parts, codes, squared distances), a block of vectors at a time."""
    parts, _, m = books.shape
    grids = [Grid(b) for b in books]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = vectors.matrix(part.column("v"), parts * m).reshape(-1, parts, m)
            got = [g.nearest(x[:, p]) for p, g in enumerate(grids)]
            yield part, x, np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def _sums(rows: DataFrame, books) -> DataFrame:
    """(part, entry, n, sums) of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, m = books.value.shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros(books.value.shape, np.int64)
        for _, x, code, _ in _coded(batches, books.value):
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                                         names=["part", "entry", "n", "sums"])

    return rows.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each valid vector."""
    if entries > MAX_ENTRIES:
        raise ValueError(f"a code has two hex digits a part: at most {MAX_ENTRIES} entries")
    spark = df.sparkSession
    rows = shared.staged(df.filter(vectors.valid(vec_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), vectors.whole(vec_col, scale).alias("v")))
    vectors.check_range(rows)
    first = rows.filter("id is not null").orderBy("id", "v").limit(1).collect()
    dim = len(first[0]["v"]) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    m = dim // parts
    fits = rows.filter(F.size("v") == dim) if m else rows.filter("false")
    start = fits.filter("id is not null").orderBy("id", "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, m).transpose(1, 0, 2).copy()
    for _ in range(rounds if m else 0):
        sent = spark.sparkContext.broadcast(books)
        got = (_sums(fits, sent).select("part", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i")
               .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())   # entries * dim rows
        sent.unpersist()
        for r in got:
            books[r["part"], r["entry"], r["i"]] = int(r["s"]) // r["n"]
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = f"id {kind['id']}, label {kind['label']}, code string, error bigint"
    sent = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, code, dist in _coded(batches, sent.value):
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(text, pa.string()), pa.array(dist.sum(1), pa.int64())],
                                             names=["id", "label", "code", "error"])

    coded = fits.mapInArrow(encode, out) if m else rows.filter("false").selectExpr("id", "label", "cast(null as string) code", "cast(null as bigint) error")
    odd = (rows.filter(F.size("v") != dim) if m else rows).selectExpr("id", "label", "cast(null as string) code", "cast(null as bigint) error")
    done = shared.staged(coded.unionByName(odd))
    sent.unpersist()
    per = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return (done.alias("a").join(per.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")), "left")
            .select(F.col("a.id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
