"""Encoders and embedding relations.

The built-in encoder is the SQL hash encoder: tokens -> md5 -> (dim, sign),
weights are signed term counts (integers, so sums are exact and engine
independent).  Its natural output is *sparse*: ``(ids..., dim, w)``.

A pluggable dense encoder implements :class:`Encoder` (a pandas-Series ->
vectors function) and runs inside ``mapInPandas`` on Arrow batches; only the
distinct texts are encoded.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.functions.hashing import DEFAULT_DIM, hash_dim, hash_sign
from lakejoin.functions.text import cell_text, words
from lakejoin.functions.vectors import NORM_EPS


def tokens(text, mode: str = "words"):
    if mode == "whole":
        return F.when(text.isNotNull(), F.array(text)).otherwise(F.array())
    return words(text)


def hash_encode(df: DataFrame, ids: list[str], text_col: str, dim: int = DEFAULT_DIM,
                mode: str = "words", offset_col: str | None = None) -> DataFrame:
    """E1 (hash): sparse vectors ``(ids..., dim, w)``; ``w`` = sum of signed
    term counts per dimension, zero weights dropped.  ``offset_col`` shifts
    dimensions by ``offset * dim`` (concatenation of several vectors)."""
    keep = ids + ([offset_col] if offset_col else [])
    t = df.select(*keep, F.explode(tokens(F.col(text_col), mode)).alias("token"))
    tf = t.groupBy(*keep, "token").agg(F.count(F.lit(1)).alias("tf"))
    h = tf.withColumn("digest", F.md5("token"))
    d = hash_dim(F.col("digest"), dim)
    if offset_col:
        d = d + F.col(offset_col) * F.lit(dim)
    return (h.groupBy(*ids, d.alias("dim"))
            .agg(F.sum(hash_sign(F.col("digest")) * F.col("tf")).alias("w"))
            .where(F.col("w") != 0))


def sparse_norms(sparse: DataFrame, ids: list[str]) -> DataFrame:
    return sparse.groupBy(*ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def sparse_unit(sparse: DataFrame, ids: list[str], eps: float = NORM_EPS) -> DataFrame:
    """E5 on sparse vectors: w / max(|w|, eps) as double."""
    n = sparse_norms(sparse, ids)
    return (sparse.join(n, ids).select(*ids, "dim", (F.col("w") / F.greatest("norm", F.lit(eps))).alias("w")))


def to_dense(sparse: DataFrame, ids: list[str], width: int) -> DataFrame:
    """Sparse -> ``vec array<double>`` of fixed width (per-id map lookup)."""
    m = sparse.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("dim").cast("int"), F.col("w").cast("double")))).alias("m"))
    return m.select(*ids, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                      lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def l2_normalize_dense(df: DataFrame, vec: str = "vec", eps: float = NORM_EPS) -> DataFrame:
    """E5 on dense vectors."""
    from lakejoin.functions.vectors import l2_normalize, norm
    return (df.withColumn("_norm", norm(F.col(vec)))
            .withColumn(vec, l2_normalize(F.col(vec), F.col("_norm"), eps)).drop("_norm"))


class Encoder(Protocol):
    """Pluggable text encoder: texts -> float matrix [n, dim]."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode_texts(df: DataFrame, text_col: str, encoder: Encoder) -> DataFrame:
    """E1 (plug-in): ``(text, vec array<float>)`` for the distinct texts of
    ``df``; run on executors over Arrow batches."""
    distinct = df.select(F.col(text_col).alias("text")).distinct()

    def run(batches):
        for pdf in batches:
            vecs = encoder.encode(pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"text": pdf["text"], "vec": [np.asarray(v, dtype=np.float32) for v in vecs]})

    return distinct.mapInPandas(run, "text string, vec array<float>")


def column_embeddings_hash(col_text: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """Sparse column embeddings ``(table_id, col_name, dim, w)`` of P1 texts."""
    return hash_encode(col_text, ["table_id", "col_name"], "text", dim)


def key_rows(lake, override: list[int] | None = None) -> DataFrame:
    """C10 + C11: key cells of every row, ``(table_id, row_idx, key_pos,
    col_name, value)`` with short rows padded by ''.

    Key choice per table: ``override`` (range-filtered, possibly empty), else
    the declared keys, else all columns."""
    from lakejoin.operators.catalog import key_columns_b
    keys = key_columns_b(lake, override)
    rows = lake.cells.select("table_id", "row_idx").distinct()
    # rows x keys of the same table; a hot table is split by AQE's skew join
    grid = rows.join(keys, "table_id")
    cells = lake.cells.select("table_id", "row_idx", "col_idx", "value")
    return (grid.join(cells, ["table_id", "row_idx", "col_idx"], "left")
            .select("table_id", "row_idx", "key_pos", "col_name",
                    F.coalesce(F.col("value"), F.lit("")).alias("value")))


def row_embeddings_hash(krows: DataFrame, dim: int) -> DataFrame:
    """E3 (hash): encode each key cell ``col : val`` (P6) and concatenate in
    key order (dimension offset = key_pos * dim).  Output sparse
    ``(table_id, row_idx, arity, dim, w)`` with integer weights; unit
    normalisation (E4/E5) happens in the similarity step, which divides the
    exact integer dot product by both norms."""
    return _key_vectors(krows, dim).join(_arity(krows), ROW_IDS)


ROW_IDS = ["table_id", "row_idx"]


def _arity(krows: DataFrame) -> DataFrame:
    return krows.groupBy(*ROW_IDS).agg(F.count(F.lit(1)).cast("int").alias("arity"))


def _key_vectors(krows: DataFrame, dim: int) -> DataFrame:
    texts = krows.select(*ROW_IDS, "key_pos", cell_text(F.col("col_name"), F.col("value")).alias("text"))
    return hash_encode(texts, ROW_IDS, "text", dim, offset_col="key_pos")


def packed_key_rows(krows: DataFrame, dim: int) -> DataFrame:
    """Packed E3 rows of every key row: a row without tokens keeps its place
    with empty entry lists (a zero vector), so it counts in J4's ratio."""
    none = lambda t: F.array().cast(f"array<{t}>")
    return (_arity(krows).join(_pack(_key_vectors(krows, dim), ROW_IDS), ROW_IDS, "left")
            .select(*ROW_IDS, "arity", F.coalesce("dims", none("int")).alias("dims"), F.coalesce("ws", none("double")).alias("ws")))


def packed_rows(sparse_rows: DataFrame) -> DataFrame:
    """Sparse row embeddings -> ``(table_id, row_idx, arity, dims, ws)``: the
    non-zero entries per row, densified inside the block tasks (numpy) instead
    of by per-element lookups in SQL.  Rows without entries are not in the
    input: use :func:`packed_key_rows` where they must stay."""
    return _pack(sparse_rows, [*ROW_IDS, "arity"])


def _pack(sparse_rows: DataFrame, ids: list[str]) -> DataFrame:
    e = sparse_rows.groupBy(*ids).agg(F.collect_list(F.struct(F.col("dim").cast("int").alias("d"),
                                                               F.col("w").cast("double").alias("w"))).alias("e"))
    return e.select(*ids, F.transform("e", lambda x: x["d"]).alias("dims"),
                    F.transform("e", lambda x: x["w"]).alias("ws"))


def dense_rows(sparse_rows: DataFrame, dim: int) -> DataFrame:
    """Sparse row embeddings -> ``(table_id, row_idx, arity, vec)`` of width
    ``arity * dim`` (rows whose cells all hash to zero stay as zero vectors)."""
    ids = ["table_id", "row_idx", "arity"]
    m = sparse_rows.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("dim").cast("int"), F.col("w").cast("double")))).alias("m"))
    return m.select(*ids, F.transform(F.sequence(F.lit(0), F.col("arity") * F.lit(dim) - 1),
                                      lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))
