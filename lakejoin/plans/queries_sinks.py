"""Sink and fitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejoin.operators import evaluate as E
from lakejoin.operators import fit as FT
from lakejoin.plans.flows import DEFAULT_K
from lakejoin.plans.queries_catalog import scratch
from lakejoin.plans.queries_eval import KS, M1_SQL, TRUTH, _star_eval, m3_sql
from lakejoin.plans.queries_rows import CENTROID_TRUTH_SQL, VEC_ALPHA, VEC_SQL, _j4_sql, _vec_eval, vector_rows
from lakejoin.plans.queries_text import column_links_sql, table_search_ctes
from lakejoin.plans.registry import r6, register
from lakejoin.plans.flows import search_joinable
from lakejoin.plans.training import fit_from_truth
from lakejoin.session import cut_lineage
from lakejoin.sources import sinks as K
from lakejoin.sources import testdata as T

TOP_PRINT = 5


@register("prediction_report", f"""WITH {table_search_ctes()}, {TRUTH}, {M1_SQL},
c AS (SELECT query_id, string_agg(cand_id, ',' ORDER BY rank) AS candidates FROM preds GROUP BY query_id)
SELECT r.query_id AS query_table_id, {DEFAULT_K} AS k, round(m1.p_at_k, 6) AS p_at_k, round(m1.r_at_k, 6) AS r_at_k,
       round(m1.ap_at_k, 6) AS ap_at_k, coalesce(c.candidates, '') AS candidates
FROM runq r LEFT JOIN m1 ON m1.query_id = r.query_id LEFT JOIN c ON c.query_id = r.query_id""")
def prediction_report(spark, sf):
    preds, run, truth, tq = _star_eval(spark, sf)
    rep = K.prediction_report(preds, run, E.metrics_a(preds, run, truth, tq, DEFAULT_K), DEFAULT_K)
    path = scratch(spark, "report")
    K.write_json(rep, path)
    back = spark.read.schema(rep.schema).json(path)
    return back.select("query_table_id", "k", F.round("metrics.p_at_k", 6).alias("p_at_k"),
                       F.round("metrics.r_at_k", 6).alias("r_at_k"), F.round("metrics.ap_at_k", 6).alias("ap_at_k"),
                       F.array_join("candidates", ",").alias("candidates"))


@register("link_report", f"""WITH lr AS ({column_links_sql()})
SELECT table1, table2, column1, column2, prob FROM lr""")
def link_report(spark, sf):
    from lakejoin.plans.queries_text import column_links
    rep = K.link_report(column_links(spark, sf))
    path = scratch(spark, "links-out")
    K.write_json(rep, path)
    return spark.read.schema(rep.schema).json(path).select("table1", "table2", "column1", "column2", r6("prob"))


def _vec_ranking(spark, sf):
    v = vector_rows(spark, sf)
    return search_joinable(v, v, v.select("table_id", "table_pos").distinct(), VEC_ALPHA)


@register("result_map", f"""WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}
SELECT query_id, CAST(rank - 1 AS INTEGER) AS pos, cand_id, round(score, 6) AS score FROM preds""")
def result_map_q(spark, sf):
    m = K.result_map(_vec_ranking(spark, sf))
    return m.select("query_id", F.posexplode("results").alias("pos", "r")).select(
        "query_id", "pos", F.col("r.cand_id").alias("cand_id"), F.round("r.score", 6).alias("score"))


@register("result_whole", f"""WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}, {CENTROID_TRUTH_SQL}, {m3_sql()}
SELECT 'results' AS part, query_id, CAST(NULL AS INTEGER) AS k, CAST(rank AS BIGINT) AS rank, cand_id, round(score, 6) AS score,
       CAST(NULL AS DOUBLE) AS p_at_k, CAST(NULL AS DOUBLE) AS r_at_k, CAST(NULL AS DOUBLE) AS map_at_k, CAST(NULL AS DOUBLE) AS mrr_at_k FROM preds
UNION ALL SELECT 'query', query_id, k, NULL, NULL, NULL, round(p_at_k, 6), round(r_at_k, 6), round(map_at_k, 6), round(mrr_at_k, 6) FROM m3
UNION ALL SELECT 'average', NULL, k, NULL, NULL, NULL, round(avg(p_at_k), 6), round(avg(r_at_k), 6), round(avg(map_at_k), 6), round(avg(mrr_at_k), 6)
FROM m3 GROUP BY k""")
def result_whole(spark, sf):
    """The whole result of a row search, written as one version and read back."""
    ranking, run, truth = _vec_eval(spark, sf)
    ranking = cut_lineage(ranking)
    per_query = cut_lineage(E.metrics_b(ranking, run, truth, KS))
    path = scratch(spark, "result")
    K.write_result(ranking, per_query, E.average_b(per_query), path, max(KS))
    back = K.read_result(spark, path)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    metrics = [r6(c) for c in ("p_at_k", "r_at_k", "map_at_k", "mrr_at_k")]
    rows = back["results"].select("query_id", "from_rank", F.posexplode("results").alias("pos", "r")).select(
        F.lit("results").alias("part"), "query_id", none("k", "int"), (F.col("from_rank") + F.col("pos")).alias("rank"),
        F.col("r.cand_id").alias("cand_id"), F.round("r.score", 6).alias("score"), *[none(c, "double") for c in ("p_at_k", "r_at_k", "map_at_k", "mrr_at_k")])
    kept = [none("rank", "long"), none("cand_id", "string"), none("score", "double"), *metrics]
    return (rows.unionByName(back["per_query_metrics"].select(F.lit("query").alias("part"), "query_id", "k", *kept))
            .unionByName(back["avg_metrics"].select(F.lit("average").alias("part"), none("query_id", "string"), "k", *kept)))


@register("top_results", f"""WITH {VEC_SQL}, {_j4_sql(VEC_ALPHA)}
SELECT query_id, cand_id, round(score, 6) AS score, rank FROM preds WHERE rank <= {TOP_PRINT}""")
def top_results(spark, sf):
    return K.top_rows(_vec_ranking(spark, sf), TOP_PRINT).select("query_id", "cand_id", r6("score"), "rank")


@register("fit_pairs")
def fit_pairs(spark, sf):
    """Fit on the star lake's truth, save, reload, score the training pairs."""
    lake = T.star_lake(spark, sf)
    path = scratch(spark, "model")
    model, feats = fit_from_truth(lake, T.star_truth(spark, sf), model_path=path)
    loaded = FT.load(path)
    out = loaded.transform(feats)
    return out.select("pair_id", "label", F.round("cos", 6).alias("cos"), F.round("cont1", 6).alias("cont1"),
                      F.round("cont2", 6).alias("cont2"), F.col("prediction"))
