"""Profiles, value sampling, column text, embeddings, column links (A, W1-W3, P1-P2, E2, J2-J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejoin.functions.hashing import DEFAULT_DIM
from lakejoin.operators import profile as P
from lakejoin.operators.similarity import table_search_columns
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.flows import DEFAULT_K, discover_tables, stored_column_embeddings
from lakejoin.plans.registry import r6, register
from lakejoin.sources.testdata import star_lake

STAR = O.lake_ctes("star")


# ---- A1 value_frequency ------------------------------------------------------
@register("value_frequency", f"""WITH {STAR}
SELECT table_id, col_name, value, count(*) AS freq, min(row_idx) AS first_row
FROM cells WHERE value IS NOT NULL GROUP BY ALL""")
def value_frequency(spark, sf):
    return P.value_frequency(star_lake(spark, sf).cells)


# ---- A2 column_profile -------------------------------------------------------
@register("column_profile", f"""WITH {STAR}, {O.column_text_ctes().strip()}
SELECT table_id, col_name, n_distinct, max_len, min_len, round(avg_len, 6) AS avg_len FROM profile""")
def column_profile(spark, sf):
    p = P.column_profile(P.value_groups(star_lake(spark, sf).cells))
    return p.select("table_id", "col_name", "n_distinct", "max_len", "min_len", r6("avg_len"))


# ---- A3 lake_value_frequency ---------------------------------------------------
@register("lake_value_frequency", f"""WITH {STAR}
SELECT c.value, count(*) AS freq FROM cells c
WHERE c.value IS NOT NULL AND EXISTS (SELECT 1 FROM columns k WHERE k.key_pos IS NOT NULL
  AND k.table_id = c.table_id AND k.col_idx = c.col_idx) GROUP BY c.value""")
def lake_value_frequency(spark, sf):
    return P.lake_value_frequency(star_lake(spark, sf))


# ---- W1 value ranks (own and lake frequency), J9 --------------------------------
@register("value_rank_own", f"""WITH {STAR}, {O.column_text_ctes().strip()}
SELECT table_id, col_name, value, rn FROM ranked""")
def value_rank_own(spark, sf):
    lake = star_lake(spark, sf)
    r = P.rank_all_values(P.value_frequency(lake.cells))
    return r.select("table_id", "col_name", "value", "rn")


LAKE_FREQ = """lfreq AS (SELECT c.value, count(*) AS freq FROM cells c
WHERE c.value IS NOT NULL AND EXISTS (SELECT 1 FROM columns k WHERE k.key_pos IS NOT NULL
  AND k.table_id = c.table_id AND k.col_idx = c.col_idx) GROUP BY c.value)"""


@register("value_rank_lake", f"""WITH {STAR}, {LAKE_FREQ}, {O.column_text_ctes(lake_freq='lfreq').strip()}
SELECT table_id, col_name, value, rn FROM ranked""")
def value_rank_lake(spark, sf):
    lake = star_lake(spark, sf)
    r = P.rank_all_cells(lake.cells, P.lake_value_frequency(lake))
    return r.select("table_id", "col_name", "value", "rn")


# ---- P2 / W2 budgeted sample -------------------------------------------------
@register("value_sample_budget", f"""WITH {STAR}, {O.column_text_ctes().strip()}
SELECT table_id, col_name, rn, value FROM sample""")
def value_sample_budget(spark, sf):
    lake = star_lake(spark, sf)
    r = P.rank_values(P.value_frequency(lake.cells))
    return P.sample_values(r)


# ---- P1 column text, six patterns ------------------------------------------------
def _text_query(pattern):
    def run(spark, sf):
        return P.column_text(star_lake(spark, sf), pattern)
    return run


for _pat in P.PATTERNS:
    register(f"column_text_{_pat.replace('-', '_')}", f"""WITH {STAR}, {O.column_text_ctes(pattern=_pat).strip()}
SELECT table_id, col_name, text FROM coltext""")(_text_query(_pat))


def star_embeddings(spark, sf, lake):
    """Embeddings of every column of the star lake, from the store that the queries share."""
    return stored_column_embeddings(lake, f"star|{sf}")


# ---- E2 column embeddings (sparse hash) ----------------------------------------------
@register("column_embeddings_hash", f"""WITH {STAR}, {O.column_text_ctes().strip()},
{O.hash_ctes('coltext', ['table_id', 'col_name'], 'text', DEFAULT_DIM).strip()}
SELECT table_id, col_name, dim, w FROM emb""")
def column_embeddings(spark, sf):
    return star_embeddings(spark, sf, star_lake(spark, sf)).drop("norm")


# ---- J2 / W3 / K2 all-pairs column links (flagship) ----------------------------------------
def column_links_sql(k: int = DEFAULT_K) -> str:
    return f"""WITH {STAR}, {O.column_text_ctes().strip()},
{O.hash_ctes('coltext', ['table_id', 'col_name'], 'text', DEFAULT_DIM).strip()},
{O.cosine_cte('sims', 'emb', 'emb', ['table_id', 'col_name'], 'a_', 'b_', '{a}.table_id < {b}.table_id').strip()},
top AS (
  SELECT a_table_id AS table1, b_table_id AS table2, a_col_name AS column1, b_col_name AS column2, sim AS prob,
         row_number() OVER (PARTITION BY a_table_id, b_table_id ORDER BY sim DESC, a_col_name, b_col_name) AS rank
  FROM sims WHERE sim > 0)
SELECT table1, table2, column1, column2, round(prob, 6) AS prob, rank FROM top WHERE rank <= {k}"""


@register("column_links_topk", column_links_sql())
def column_links(spark, sf):
    from lakejoin.plans.flows import discover_column_links
    lake = star_lake(spark, sf)
    out = discover_column_links(lake, DEFAULT_K, emb=star_embeddings(spark, sf, lake))
    return out.select("table1", "table2", "column1", "column2", r6("prob"), "rank")


# ---- J3 / A4 / A5 / W4 table search by key columns ---------------------------------------
def table_search_ctes(k: int = DEFAULT_K, lake: str = STAR) -> str:
    """CTEs ending in ``preds(query_id, cand_id, score, rank)`` (score unrounded)."""
    keycells = ("kcells AS (SELECT c.* FROM cells c JOIN columns k ON k.table_id = c.table_id "
                "AND k.col_idx = c.col_idx AND k.key_pos IS NOT NULL)")
    keycols = "kcols AS (SELECT * FROM columns WHERE key_pos IS NOT NULL)"
    return f"""{lake}, {keycells}, {keycols}, {O.column_text_ctes(cells='kcells', columns='kcols').strip()},
{O.hash_ctes('coltext', ['table_id', 'col_name'], 'text', DEFAULT_DIM).strip()},
{O.cosine_cte('sims', 'emb', 'emb', ['table_id', 'col_name'], 'q_', 'l_').strip()},
best AS (SELECT q_table_id, l_table_id, q_col_name, greatest(max(sim), 0.0) AS best FROM sims GROUP BY ALL),
nq AS (SELECT table_id AS q_table_id, count(*) AS n_q FROM kcols GROUP BY ALL),
score AS (SELECT b.q_table_id AS query_id, b.l_table_id AS cand_id, list_reduce(list(best ORDER BY q_col_name), lambda x, y: x + y) / n_q AS score
          FROM best b JOIN nq ON nq.q_table_id = b.q_table_id GROUP BY b.q_table_id, b.l_table_id, n_q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank
        FROM score WHERE score > 0),
preds AS (SELECT query_id, cand_id, score, rank FROM top WHERE rank <= {k}),
runq AS (SELECT DISTINCT table_id AS query_id FROM kcols)"""


def star_predictions(spark, sf, k: int = DEFAULT_K):
    """(lake, predictions) of F1 over the star lake (query = lake)."""
    lake = star_lake(spark, sf)
    keys = lake.key_columns().select("table_id", "col_name")
    emb = star_embeddings(spark, sf, lake).join(keys, ["table_id", "col_name"], "left_semi")
    return lake, table_search_columns(emb, emb, keys, k)


@register("table_search_columns", f"""WITH {table_search_ctes()}
SELECT query_id, cand_id, round(score, 6) AS score, rank FROM preds""")
def table_search(spark, sf):
    _, out = star_predictions(spark, sf)
    return out.select("query_id", "cand_id", r6("score"), "rank")


@register("table_search_columns_convs", f"""WITH {table_search_ctes(lake=O.lake_ctes('conv'))}
SELECT query_id, cand_id, round(score, 6) AS score, rank FROM preds""")
def table_search_convs(spark, sf):
    """F1 over the conversation lake: more tables than k, so the bounds cut."""
    from lakejoin.sources.testdata import conversations_lake
    out = discover_tables(conversations_lake(spark, sf), k=DEFAULT_K)
    return out.select("query_id", "cand_id", r6("score"), "rank")


# ---- J8 embedding lookup of the declared link columns ------------------------------------
@register("embedding_lookup", f"""WITH {STAR}, {O.column_text_ctes().strip()},
{O.hash_ctes('coltext', ['table_id', 'col_name'], 'text', DEFAULT_DIM).strip()},
links AS ({O.star_links()}),
ends AS (SELECT table1 AS table_id, column1 AS col_name FROM links UNION SELECT table2, column2 FROM links)
SELECT e.table_id, e.col_name, e.dim, e.w FROM emb e JOIN ends USING (table_id, col_name)""")
def embedding_lookup(spark, sf):
    from lakejoin.sources.testdata import star_links
    lake = star_lake(spark, sf)
    emb = star_embeddings(spark, sf, lake)
    links = star_links(spark, sf)
    ends = (links.select(F.col("table1").alias("table_id"), F.col("column1").alias("col_name"))
            .union(links.select(F.col("table2").alias("table_id"), F.col("column2").alias("col_name"))).distinct())
    return emb.join(ends, ["table_id", "col_name"]).select("table_id", "col_name", "dim", "w")
