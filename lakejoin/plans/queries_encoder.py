"""The three searches with a plug-in encoder (E1 through E2-E4): a fixed small
encoder that SQL can state, so its results can be compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejoin.functions.vectors import COS_EPS
from lakejoin.operators.dictionary import LetterEncoder, column_embeddings_dense, row_embeddings_dense
from lakejoin.operators.encode import key_rows
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.flows import DEFAULT_K, discover_column_links, discover_tables, search_joinable_lakes
from lakejoin.plans.queries_eval import KS
from lakejoin.plans.queries_rows import CONV_KEYROWS
from lakejoin.plans.queries_text import STAR
from lakejoin.plans.registry import r6, register
from lakejoin.sources import testdata as T

LETTERS = LetterEncoder().letters
ROW_ALPHA = 0.99      # letter counts of one language are alike


def letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({text})) - length(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def _unnested(name: str, src: str) -> str:
    return (f"{name} AS (SELECT table_id, col_name, {letters_sql('text')} AS v FROM {src}),\n"
            f"{name}_n AS (SELECT *, sqrt(list_dot_product(v, v)) + {COS_EPS} AS n FROM {name})")


CONV_KEYS = (f"{O.lake_ctes('conv')}, kcells AS (SELECT c.* FROM cells c JOIN columns k ON k.table_id = c.table_id AND k.col_idx = c.col_idx "
             "AND k.key_pos IS NOT NULL), kcols AS (SELECT * FROM columns WHERE key_pos IS NOT NULL)")


@register("column_embeddings_encoder", f"""WITH {STAR}, {O.column_text_ctes().strip()}, {_unnested('emb', 'coltext')}
SELECT table_id, col_name, CAST(u.i - 1 AS INTEGER) AS i, u.x AS x FROM emb, unnest(v) WITH ORDINALITY AS u(x, i)""")
def column_embeddings_encoder(spark, sf):
    e = column_embeddings_dense(T.star_lake(spark, sf), LetterEncoder())
    return e.select("table_id", "col_name", F.posexplode("vec").alias("i", "x"))


@register("column_links_encoder", f"""WITH {STAR}, {O.column_text_ctes().strip()}, {_unnested('emb', 'coltext')},
sims AS (SELECT a.table_id AS table1, b.table_id AS table2, a.col_name AS column1, b.col_name AS column2,
                list_dot_product(a.v, b.v) / (a.n * b.n) AS prob FROM emb_n a JOIN emb_n b ON a.table_id < b.table_id),
top AS (SELECT *, row_number() OVER (PARTITION BY table1, table2 ORDER BY prob DESC, column1, column2) AS rank FROM sims WHERE prob > 0)
SELECT table1, table2, column1, column2, round(prob, 6) AS prob, rank FROM top WHERE rank <= {DEFAULT_K}""")
def column_links_encoder(spark, sf):
    """F2 with the letter encoder."""
    out = discover_column_links(T.star_lake(spark, sf), DEFAULT_K, encoder=LetterEncoder())
    return out.select("table1", "table2", "column1", "column2", r6("prob"), "rank")


@register("table_search_columns_encoder", f"""WITH {CONV_KEYS}, {O.column_text_ctes(cells='kcells', columns='kcols').strip()}, {_unnested('emb', 'coltext')},
best AS (SELECT a.table_id AS q, a.col_name AS c, b.table_id AS l, greatest(max(list_dot_product(a.v, b.v) / (a.n * b.n)), 0.0) AS best
         FROM emb_n a, emb_n b GROUP BY ALL),
nq AS (SELECT table_id AS q, count(*) AS n_q FROM kcols GROUP BY ALL),
score AS (SELECT b.q AS query_id, b.l AS cand_id, list_reduce(list(best ORDER BY c), lambda x, y: x + y) / n_q AS score
          FROM best b JOIN nq ON nq.q = b.q GROUP BY b.q, b.l, n_q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM score WHERE score > 0)
SELECT query_id, cand_id, round(score, 6) AS score, rank FROM top WHERE rank <= {DEFAULT_K}""")
def table_search_columns_encoder(spark, sf):
    """F1 with the letter encoder over the conversation lake."""
    out = discover_tables(T.conversations_lake(spark, sf), k=DEFAULT_K, encoder=LetterEncoder())
    return out.select("query_id", "cand_id", r6("score"), "rank")


ROWS_SQL = f"""{O.lake_ctes('conv')}, {CONV_KEYROWS},
kvec AS (SELECT table_id, row_idx, key_pos, {letters_sql('text')} AS v FROM ktext),
rvec AS (SELECT table_id, row_idx, count(*) AS arity, flatten(list(v ORDER BY key_pos)) AS v FROM kvec GROUP BY ALL)"""


@register("row_embeddings_encoder", f"""WITH {ROWS_SQL}
SELECT table_id, row_idx, CAST(arity AS INTEGER) AS arity, CAST(u.i - 1 AS INTEGER) AS i, u.x AS x FROM rvec, unnest(v) WITH ORDINALITY AS u(x, i)""")
def row_embeddings_encoder(spark, sf):
    e = row_embeddings_dense(key_rows(T.conversations_lake(spark, sf)), LetterEncoder())
    return e.select("table_id", "row_idx", "arity", F.posexplode("vec").alias("i", "x"))


@register("table_search_rows_encoder", f"""WITH {ROWS_SQL},
rn AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM rvec),
hit AS (SELECT DISTINCT a.table_id AS q, a.row_idx, b.table_id AS l FROM rn a JOIN rn b ON a.arity = b.arity AND a.table_id <> b.table_id
        WHERE list_dot_product(a.v, b.v) / (a.n * b.n) > {ROW_ALPHA}),
hits AS (SELECT q, l, count(*) AS n_match FROM hit GROUP BY ALL),
asked AS (SELECT table_id AS q, arity, count(*) AS n_q FROM rvec GROUP BY ALL),
ranked AS (SELECT a.q AS query_id, t.table_id AS cand_id, coalesce(h.n_match, 0) / a.n_q AS score, t.table_pos AS lake_pos,
                  count(*) OVER (PARTITION BY a.q) AS n_pred,
                  row_number() OVER (PARTITION BY a.q ORDER BY coalesce(h.n_match, 0) / a.n_q DESC, t.table_pos, t.table_id) AS rank
           FROM asked a JOIN asked b ON a.arity = b.arity AND a.q <> b.q JOIN tables t ON t.table_id = b.q
           LEFT JOIN hits h ON h.q = a.q AND h.l = b.q)
SELECT query_id, cand_id, round(score, 6) AS score, lake_pos, rank, n_pred FROM ranked WHERE rank <= {max(KS)}""")
def table_search_rows_encoder(spark, sf):
    """F3 with the letter encoder over the conversation lake."""
    lake = T.conversations_lake(spark, sf)
    out = search_joinable_lakes(lake, lake, ROW_ALPHA, k=max(KS), encoder=LetterEncoder())
    return out.select("query_id", "cand_id", r6("score"), "lake_pos", "rank", "n_pred")
