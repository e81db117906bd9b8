"""Row-level (multi-key) search: E3-E5, J4, J5 and the B-variant metrics over
the vector lake (``embeddings`` by label) and the conversation lake
(``conversations`` by conv_id, hash-encoded key cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejoin.functions.vectors import l2_normalize, norm
from lakejoin.operators import evaluate as E
from lakejoin.operators.encode import key_rows, packed_key_rows, row_embeddings_hash
from lakejoin.operators.rank import rank_within
from lakejoin.operators.similarity import joinability_scores
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.flows import DEFAULT_ALPHA, search_joinable, search_joinable_top
from lakejoin.plans.queries_eval import KS, M3_OUT, M4_OUT, _m3_out, _m4_out, m3_sql
from lakejoin.plans.registry import r6, register
from lakejoin.session import cut_lineage
from lakejoin.sources import testdata as T

VEC_ALPHA = 0.5       # the paper's alpha; the vector lake has no pair above 0.7
ROW_DIM = 256         # hash dimensions per key cell
TRUTH_NEIGHBOURS = 3  # vector-lake truth: nearest label centroids


def vector_rows(spark, sf):
    v = T.vector_rows(spark, sf)
    return v.select("table_id", "table_pos", "row_idx", F.lit(1).alias("arity"), "vec")


VEC_SQL = """vrows AS (SELECT 'label-' || CAST(label AS VARCHAR) AS table_id, CAST(label AS BIGINT) AS table_pos,
                 CAST(vec_id AS BIGINT) AS row_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vn AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS nv FROM vrows)"""


def _j4_sql(alpha: float) -> str:
    return f"""best AS (SELECT a.table_id AS q, a.row_idx AS r, b.table_id AS l,
                 max(list_dot_product(a.v, b.v) / (a.nv * b.nv)) AS m
          FROM vn a JOIN vn b ON a.table_id <> b.table_id GROUP BY ALL),
nq AS (SELECT table_id AS q, count(*) AS n_q FROM vn GROUP BY ALL),
scores AS (SELECT b.q AS query_id, b.l AS cand_id, CAST(count(*) FILTER (WHERE m > {alpha}) AS BIGINT) AS n_match,
                  n_q, count(*) FILTER (WHERE m > {alpha}) / n_q AS score
           FROM best b JOIN nq ON nq.q = b.q GROUP BY b.q, b.l, n_q),
lpos AS (SELECT DISTINCT table_id, table_pos FROM vn),
preds AS (SELECT s.*, p.table_pos AS lake_pos,
                 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p.table_pos, cand_id) AS rank
          FROM scores s JOIN lpos p ON p.table_id = s.cand_id),
runq AS (SELECT DISTINCT table_id AS query_id FROM vn)"""


# ---- E5 l2 normalisation -------------------------------------------------------
@register("l2_normalize", f"""WITH {VEC_SQL}
SELECT table_id, row_idx, CAST(u.i - 1 AS INTEGER) AS i, round(u.x / nv, 6) AS x
FROM vn, unnest(v) WITH ORDINALITY AS u(x, i)""")
def l2_normalize_q(spark, sf):
    v = vector_rows(spark, sf).withColumn("n", norm(F.col("vec")))
    u = v.select("table_id", "row_idx", l2_normalize(F.col("vec"), F.col("n")).alias("u"))
    return u.select("table_id", "row_idx", F.posexplode("u").alias("i", "x")).select(
        "table_id", "row_idx", "i", r6("x"))


# ---- J4 joinability ratio --------------------------------------------------------
@register("joinability_ratio", f"""WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}
SELECT query_id, cand_id, n_match, n_q, round(score, 6) AS score FROM scores""")
def joinability_ratio(spark, sf):
    v = vector_rows(spark, sf)
    s = joinability_scores(v, v, VEC_ALPHA)
    return s.select("query_id", "cand_id", F.col("n_match").cast("long").alias("n_match"), "n_q", r6("score"))


# ---- J5 row-based table search -----------------------------------------------------
@register("table_search_rows", f"""WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}
SELECT query_id, cand_id, round(score, 6) AS score, lake_pos, rank FROM preds""")
def table_search_rows_q(spark, sf):
    v = vector_rows(spark, sf)
    pos = v.select("table_id", "table_pos").distinct()
    r = search_joinable(v, v, pos, VEC_ALPHA)
    return r.select("query_id", "cand_id", r6("score"), "lake_pos", "rank")


# ---- B metrics over the row ranking, truth = nearest label centroids ------------------------
CENTROID_TRUTH_SQL = f"""cent AS (SELECT table_id, u.i AS i, avg(u.x) AS x FROM vrows, unnest(v) WITH ORDINALITY AS u(x, i) GROUP BY ALL),
cnorm AS (SELECT table_id, sqrt(sum(x * x)) AS n FROM cent GROUP BY ALL),
ccos AS (SELECT a.table_id AS query_id, b.table_id AS cand_id, sum(a.x * b.x) / (na.n * nb.n) AS c
         FROM cent a JOIN cent b ON a.i = b.i AND a.table_id <> b.table_id
         JOIN cnorm na ON na.table_id = a.table_id JOIN cnorm nb ON nb.table_id = b.table_id
         GROUP BY a.table_id, b.table_id, na.n, nb.n),
truth AS (SELECT query_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, cand_id) AS rn
          FROM ccos) WHERE rn <= {TRUTH_NEIGHBOURS})"""


def centroid_truth(v):
    """Truth of the vector lake: the nearest label centroids (cosine)."""
    e = v.select("table_id", F.posexplode("vec").alias("i", "x"))
    cent = e.groupBy("table_id", (F.col("i") + 1).alias("i")).agg(F.avg("x").alias("x"))
    cn = cent.groupBy("table_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a = cent.select(F.col("table_id").alias("query_id"), "i", F.col("x").alias("xa"))
    b = cent.select(F.col("table_id").alias("cand_id"), "i", F.col("x").alias("xb"))
    cos = (a.join(b, "i").where(F.col("query_id") != F.col("cand_id"))
           .groupBy("query_id", "cand_id").agg(F.sum(F.col("xa") * F.col("xb")).alias("d"))
           .join(cn.select(F.col("table_id").alias("query_id"), F.col("n").alias("na")), "query_id")
           .join(cn.select(F.col("table_id").alias("cand_id"), F.col("n").alias("nb")), "cand_id")
           .withColumn("c", F.round(F.col("d") / (F.col("na") * F.col("nb")), 9)))
    return rank_within(cos, ["query_id"], [F.desc("c"), F.asc("cand_id")], TRUTH_NEIGHBOURS, "rn") \
        .select("query_id", "cand_id")


def _vec_eval(spark, sf):
    v = vector_rows(spark, sf)
    pos = v.select("table_id", "table_pos").distinct()
    ranking = search_joinable(v, v, pos, VEC_ALPHA)
    run = v.select(F.col("table_id").alias("query_id")).distinct()
    return ranking, run, centroid_truth(v)


@register("metrics_multi_k_rows", f"WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}, {CENTROID_TRUTH_SQL}, {m3_sql()}\n{M3_OUT}")
def metrics_multi_k_rows(spark, sf):
    ranking, run, truth = _vec_eval(spark, sf)
    return _m3_out(E.metrics_b(ranking, run, truth, KS))


@register("average_metrics_rows", f"WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}, {CENTROID_TRUTH_SQL}, {m3_sql()}\n{M4_OUT}")
def average_metrics_rows(spark, sf):
    ranking, run, truth = _vec_eval(spark, sf)
    return _m4_out(E.average_b(E.metrics_b(ranking, run, truth, KS)))


# ---- E3 multi-key row embeddings and J4/J5 over hash-encoded text rows -------------------------
CONV_KEYROWS = """krows AS (SELECT table_id, row_idx, CAST(col_idx AS BIGINT) AS key_pos, col_name, coalesce(value, '') AS value FROM cells),
ktext AS (SELECT table_id, row_idx, key_pos,
                 CASE WHEN value IS NULL OR regexp_replace(value, '^\\s+|\\s+$', '', 'g') = '' THEN col_name || ' :'
                      ELSE col_name || ' : ' || regexp_replace(value, '^\\s+|\\s+$', '', 'g') END AS text FROM krows),
arity AS (SELECT table_id, row_idx, CAST(count(*) AS INTEGER) AS arity FROM krows GROUP BY ALL)"""


def conv_rows_sql() -> str:
    return (f"{O.lake_ctes('conv')}, {CONV_KEYROWS}, "
            f"{O.hash_ctes('ktext', ['table_id', 'row_idx'], 'text', ROW_DIM, name='remb', offset='key_pos').strip()}")


@register("row_embeddings_concat", f"""WITH {conv_rows_sql()}
SELECT r.table_id, r.row_idx, a.arity, r.dim, r.w FROM remb r JOIN arity a ON a.table_id = r.table_id AND a.row_idx = r.row_idx""")
def row_embeddings_concat(spark, sf):
    lake = T.conversations_lake(spark, sf)
    return row_embeddings_hash(key_rows(lake), ROW_DIM).select("table_id", "row_idx", "arity", "dim", "w")


def text_search_sql(keyrows: str, alpha: float) -> str:
    """Ranking of hash-encoded key rows, from the CTEs ``keyrows`` (cells .. remb, tables) on."""
    return f"""WITH {keyrows},
rn AS (SELECT table_id, row_idx, greatest(norm, 1e-12) AS n FROM remb_norm),
dots AS (SELECT a.table_id AS q, a.row_idx AS r, b.table_id AS l, b.row_idx AS lr, CAST(sum(a.w * b.w) AS DOUBLE) AS d
         FROM remb a JOIN remb b ON a.dim = b.dim AND a.table_id <> b.table_id GROUP BY ALL),
best AS (SELECT d.q, d.r, d.l, max(d.d / (na.n * nb.n)) AS m FROM dots d
         JOIN rn na ON na.table_id = d.q AND na.row_idx = d.r JOIN rn nb ON nb.table_id = d.l AND nb.row_idx = d.lr
         GROUP BY ALL),
qa AS (SELECT DISTINCT a.table_id, a.arity FROM arity a),
pairs AS (SELECT x.table_id AS q, y.table_id AS l FROM qa x JOIN qa y ON x.arity = y.arity AND x.table_id <> y.table_id),
nq AS (SELECT table_id AS q, count(*) AS n_q FROM arity GROUP BY ALL),
scores AS (SELECT p.q AS query_id, p.l AS cand_id, count(b.r) FILTER (WHERE b.m > {alpha}) / n_q AS score
           FROM pairs p JOIN nq ON nq.q = p.q LEFT JOIN best b ON b.q = p.q AND b.l = p.l GROUP BY p.q, p.l, n_q),
ranked AS (SELECT s.query_id, s.cand_id, s.score, t.table_pos AS lake_pos, count(*) OVER (PARTITION BY s.query_id) AS n_pred,
                  row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, t.table_pos, s.cand_id) AS rank
           FROM scores s JOIN tables t ON t.table_id = s.cand_id)
SELECT query_id, cand_id, round(score, 6) AS score, lake_pos, rank, n_pred FROM ranked"""


@register("table_search_rows_text", text_search_sql(conv_rows_sql(), DEFAULT_ALPHA))
def table_search_rows_text(spark, sf):
    """The whole ranking of every conversation."""
    lake = T.conversations_lake(spark, sf)
    rows = packed_key_rows(key_rows(lake), ROW_DIM)
    r = search_joinable_top(rows, rows, lake.tables.select("table_id", "table_pos"), None, DEFAULT_ALPHA, ROW_DIM)
    return r.select("query_id", "cand_id", r6("score"), "lake_pos", "rank", "n_pred")


# ---- the same ranking where the prefix filter does the work: long sparse vectors, many equal rows ----
SPARSE_DIM = 1 << 20
SPARSE_ALPHA = 0.9


@register("table_search_rows_prefix", f"""WITH {O.lake_ctes('events')}, {CONV_KEYROWS},
r AS (SELECT table_id, row_idx, string_agg(text, chr(31) ORDER BY key_pos) AS t FROM ktext GROUP BY ALL),
ids AS (SELECT table_id, row_idx, dense_rank() OVER (ORDER BY t) AS vid FROM r),
vtext AS (SELECT DISTINCT i.vid, k.key_pos, k.text FROM ids i JOIN ktext k ON k.table_id = i.table_id AND k.row_idx = i.row_idx),
{O.hash_ctes('vtext', ['vid'], 'text', SPARSE_DIM, name='remb', offset='key_pos').strip()},
dots AS (SELECT a.vid AS q, b.vid AS l, CAST(sum(a.w * b.w) AS DOUBLE) AS d FROM remb a JOIN remb b ON a.dim = b.dim GROUP BY ALL),
near AS (SELECT d.q, d.l FROM dots d JOIN remb_norm x ON x.vid = d.q JOIN remb_norm y ON y.vid = d.l WHERE d.d / (x.norm * y.norm) > {SPARSE_ALPHA}),
vtab AS (SELECT table_id, vid, count(*) AS n FROM ids GROUP BY ALL),
met AS (SELECT DISTINCT n.q, v.table_id AS l FROM near n JOIN vtab v ON v.vid = n.l),
hit AS (SELECT v.table_id AS query_id, m.l AS cand_id, sum(v.n) AS n_match FROM vtab v JOIN met m ON m.q = v.vid AND m.l <> v.table_id GROUP BY ALL),
nq AS (SELECT table_id AS query_id, count(*) AS n_q FROM ids GROUP BY ALL),
ranked AS (SELECT q.query_id, t.table_id AS cand_id, coalesce(h.n_match, 0) / q.n_q AS score, t.table_pos AS lake_pos,
                  count(*) OVER (PARTITION BY q.query_id) AS n_pred,
                  row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(h.n_match, 0) / q.n_q DESC, t.table_pos, t.table_id) AS rank
           FROM nq q JOIN tables t ON t.table_id <> q.query_id LEFT JOIN hit h ON h.query_id = q.query_id AND h.cand_id = t.table_id)
SELECT query_id, cand_id, round(score, 6) AS score, lake_pos, rank, n_pred FROM ranked WHERE rank <= {max(KS)}""")
def table_search_rows_prefix(spark, sf):
    """Users' event tables ranked by the share of their rows that another user has, by the prefix join."""
    lake = T.events_lake(spark, sf)
    rows = packed_key_rows(key_rows(lake), SPARSE_DIM)
    r = search_joinable_top(rows, rows, lake.tables.select("table_id", "table_pos"), max(KS), SPARSE_ALPHA, SPARSE_DIM, path="prefix")
    return r.select("query_id", "cand_id", r6("score"), "lake_pos", "rank", "n_pred")


# ---- J4 with rows that have no token -----------------------------------------------------------
@register("row_search_no_token", f"""WITH r AS (SELECT 'src-' || source AS table_id, doc_id AS row_idx,
  CASE WHEN lang = 'en' THEN NULL ELSE lang END AS v FROM documents WHERE source IS NOT NULL),
nq AS (SELECT table_id, count(*) AS n_q FROM r GROUP BY ALL),
has AS (SELECT DISTINCT table_id, v FROM r WHERE v IS NOT NULL),
hit AS (SELECT r.table_id AS q, h.table_id AS l, count(*) AS n_match FROM r JOIN has h ON h.v = r.v AND h.table_id <> r.table_id GROUP BY ALL)
SELECT a.table_id AS query_id, b.table_id AS cand_id, coalesce(h.n_match, 0) AS n_match, a.n_q,
       round(coalesce(h.n_match, 0) / a.n_q, 6) AS score
FROM nq a JOIN nq b ON a.table_id <> b.table_id LEFT JOIN hit h ON h.q = a.table_id AND h.l = b.table_id""")
def row_search_no_token(spark, sf):
    """One table per source with the key column ``#``: the language, but for
    English documents the text without letters and digits, which has no token."""
    bare = F.regexp_replace("text", r"[\p{L}\p{N}]", "")
    krows = (T.read(spark, sf, "documents").where(F.col("source").isNotNull())
             .select(F.concat(F.lit("src-"), "source").alias("table_id"), F.col("doc_id").cast("long").alias("row_idx"),
                     F.lit(0).alias("key_pos"), F.lit("#").alias("col_name"),
                     F.when(F.col("lang") == "en", bare).otherwise(F.col("lang")).alias("value")))
    rows = cut_lineage(packed_key_rows(krows, ROW_DIM))
    s = joinability_scores(rows, rows, DEFAULT_ALPHA, packed_dim=ROW_DIM)
    return s.select("query_id", "cand_id", F.col("n_match").cast("long").alias("n_match"), "n_q", r6("score"))
