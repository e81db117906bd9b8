"""End-to-end workflows (F1-F3; F4-F6 in :mod:`lakejoin.plans.training`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.functions.hashing import DEFAULT_DIM
from lakejoin.lake import Lake
from lakejoin.operators.encode import Encoder, column_embeddings_hash
from lakejoin.operators.profile import column_text
from lakejoin.operators.similarity import column_links_topk, table_search_columns
from lakejoin.session import cut_lineage

DEFAULT_K = 30
DEFAULT_ALPHA = 0.7


def lake_column_embeddings(lake: Lake, dim: int = DEFAULT_DIM, pattern: str = "title-colname-stat-col",
                           keys_only: bool = False) -> DataFrame:
    """Sparse embeddings of the P1 text of every (or every key) column."""
    if keys_only:
        text = column_text(lake, pattern, cells=lake.key_cells(), columns=lake.key_columns())
    else:
        text = column_text(lake, pattern)
    # the embedding table is read several times by the similarity join (both
    # sides and the norms): materialise it once in the shared checkpoint folder
    return cut_lineage(column_embeddings_hash(text, dim))


def stored_column_embeddings(lake: Lake, name: str, dim: int = DEFAULT_DIM, pattern: str = "title-colname-stat-col",
                             root: str | None = None) -> DataFrame:
    """E2 through the embedding store: ``(table_id, col_name, dim, w, norm)`` of
    every column, encoded once per lake version and read by table without an
    exchange.  ``name`` tells lakes apart."""
    from lakejoin.operators.store import EmbeddingStore
    store = EmbeddingStore(lake.tables.sparkSession, f"{name}|hash-{dim}|{pattern}", root=root)

    def encode(part: Lake) -> DataFrame:
        e = column_embeddings_hash(column_text(part, pattern), dim)
        column = Window.partitionBy("table_id", "col_name")
        return e.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(column)))

    store.refresh(lake, encode, names=pattern == "title-colname-col")     # the only pattern that prints the table's name
    return store.rows()


def discover_column_links(lake: Lake, k: int = DEFAULT_K, dim: int = DEFAULT_DIM, path: str = "auto",
                          block_rows: int = 4096, encoder: Encoder | None = None, emb: DataFrame | None = None) -> DataFrame:
    """top-k column pairs for every table pair of the lake (K2 rows).

    ``path``: ``sparse`` (equi-join on hash dimensions), ``dense`` (block
    matmul, per-block top-k) or ``auto``: dense once the vectors fill more
    than 1/8 of the dimensions, where the inverted index stops pruning.  Both
    paths give identical results (integer weights, same formula).  ``encoder``: a
    plug-in encoder in place of the hash encoder; ``emb``: the hash embeddings, if
    they are at hand (e.g. from the store)."""
    from pyspark.sql import functions as F
    from lakejoin.operators.encode import to_dense
    from lakejoin.operators.similarity import blocks_for, column_links_topk_dense
    if encoder is not None:
        from lakejoin.operators.dictionary import column_embeddings_dense
        vecs = column_embeddings_dense(lake, encoder)
        return column_links_topk_dense(vecs, k, blocks_for(vecs.count(), block_rows))
    emb = lake_column_embeddings(lake, dim) if emb is None else emb
    if path == "auto":
        st = emb.groupBy("table_id", "col_name").count().agg(F.avg("count"), F.count(F.lit(1))).first()
        n_cols, nnz = int(st[1] or 0), float(st[0] or 0.0)
        path = "dense" if nnz > dim / 8 else "sparse"
    if path == "dense":
        n_cols = emb.select("table_id", "col_name").distinct().count()
        vecs = to_dense(emb, ["table_id", "col_name"], dim)
        return column_links_topk_dense(vecs, k, blocks_for(n_cols, block_rows))
    return column_links_topk(emb, k)


def discover_tables(query: Lake, lake: Lake | None = None, k: int = DEFAULT_K,
                    dim: int = DEFAULT_DIM, encoder: Encoder | None = None) -> DataFrame:
    """F1 ranking: top-k lake tables per query table by key-column similarity
    (self matches kept).  ``lake`` defaults to the query lake itself;
    ``encoder``: a plug-in encoder in place of the hash encoder."""
    if encoder is not None:
        from lakejoin.operators.dictionary import column_embeddings_dense
        from lakejoin.operators.similarity import table_search_columns_dense
        q_vecs = column_embeddings_dense(query, encoder, keys_only=True)
        l_vecs = q_vecs if lake is None else column_embeddings_dense(lake, encoder, keys_only=True)
        return table_search_columns_dense(q_vecs, l_vecs, query.key_columns().select("table_id", "col_name"), k)
    q_emb = lake_column_embeddings(query, dim, keys_only=True)
    if lake is None:
        l_emb = q_emb
    else:
        l_emb = lake_column_embeddings(lake, dim, keys_only=True)
    q_keys = query.key_columns().select("table_id", "col_name")
    return table_search_columns(q_emb, l_emb, q_keys, k)


def search_joinable(q_rows: DataFrame, l_rows: DataFrame, lake_pos: DataFrame,
                    alpha: float = DEFAULT_ALPHA, q_blocks: int | None = None,
                    l_blocks: int | None = None, block_rows: int = 4096,
                    packed_dim: int | None = None) -> DataFrame:
    """F3 ranking: every lake table (self excluded, equal key arity) ranked per
    query table by the share of query rows with a lake row above ``alpha``;
    ties keep lake order.  Rows: ``(table_id, row_idx, arity, vec)``.

    Block counts default to ceil(rows / block_rows) (one scalar count each)."""
    from lakejoin.operators.similarity import blocks_for, joinability_scores, table_search_rows
    same = q_rows is l_rows
    q_rows = cut_lineage(q_rows)  # embeddings are computed once, read by every block pair
    l_rows = q_rows if same else cut_lineage(l_rows)
    if q_blocks is None:
        q_blocks = blocks_for(q_rows.count(), block_rows)
    if l_blocks is None:
        l_blocks = blocks_for(l_rows.count(), block_rows)
    scores = joinability_scores(q_rows, l_rows, alpha, q_blocks, l_blocks, exclude_self=True,
                                packed_dim=packed_dim)
    return table_search_rows(scores, lake_pos)


def search_joinable_top(q_rows: DataFrame, l_rows: DataFrame, lake_pos: DataFrame, k: int | None,
                        alpha: float = DEFAULT_ALPHA, packed_dim: int | None = 256, path: str = "auto") -> DataFrame:
    """F3 as used: the first ``k`` (the largest K asked for) of each ranking and
    the number of predictions ``n_pred``.  Packed rows, or dense ones with
    ``packed_dim`` None; rows of the result grow with the query tables, not with
    pairs of tables.  With ``k`` None the rankings are whole: a row a pair of tables."""
    from lakejoin.operators.threshold import match_counts, ranking_catalog, top_tables, whole_ranking
    same = q_rows is l_rows
    q_rows = cut_lineage(q_rows)
    l_rows = q_rows if same else cut_lineage(l_rows)
    if k is None:
        catalog = cut_lineage(ranking_catalog(l_rows, lake_pos))
        numbers = catalog.select(F.col("cand_id").alias("l_table_id"), "num").distinct()
        matches = match_counts(q_rows, l_rows, alpha, packed_dim, path, numbers=numbers)
        return whole_ranking(matches, q_rows, l_rows, lake_pos, catalog)
    matches = match_counts(q_rows, l_rows, alpha, packed_dim, path, (k, lake_pos))
    return top_tables(matches, q_rows, l_rows, lake_pos, k)


def search_joinable_lakes(query: Lake, lake: Lake, alpha: float = DEFAULT_ALPHA, dim: int = 256,
                          override: list[int] | None = None, k: int | None = None, path: str = "auto",
                          encoder: Encoder | None = None) -> DataFrame:
    """F3 end to end on two lakes with the hash encoder: query and lake tables
    are merged first-wins (C14), key rows chosen (C10/C11), encoded once (E3,
    E4), and every query table is ranked against the lake tables (J4, J5); with
    ``k`` only the first k of each ranking are made.  ``encoder``: a plug-in
    encoder in place of the hash encoder."""
    from lakejoin.operators.catalog import merge_lakes
    from lakejoin.operators.encode import key_rows, packed_key_rows
    both = merge_lakes(query, lake, winner="first")
    if encoder is not None:
        from lakejoin.operators.dictionary import row_embeddings_dense
        rows, dim = row_embeddings_dense(key_rows(both, override), encoder), None
    else:
        rows = cut_lineage(packed_key_rows(key_rows(both, override), dim))
    q_ids = query.tables.select("table_id")
    l_ids = lake.tables.select("table_id")
    q_rows = rows.join(q_ids, "table_id", "left_semi")
    l_rows = rows.join(l_ids, "table_id", "left_semi")
    pos = lake.tables.select("table_id", "table_pos")
    if k is not None:
        return search_joinable_top(q_rows, l_rows, pos, k, alpha, dim, path)
    return search_joinable(q_rows, l_rows, pos, alpha, packed_dim=dim)
