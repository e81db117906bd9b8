"""Evaluation queries (J10, W6, W7, M1-M4, K4) and the row-level search
(J4, J5, E4, E5) over the vector and conversation lakes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakejoin.functions.text import fmt_dec
from lakejoin.operators import evaluate as E
from lakejoin.plans import oracle_sql as O
from lakejoin.plans.flows import DEFAULT_K
from lakejoin.plans.queries_text import star_predictions, table_search_ctes
from lakejoin.plans.registry import r6, register
from lakejoin.sources import testdata as T

KS = [1, 5, 10, 30]
TRUTH = f"truth AS ({O.star_truth()}), truthq AS ({O.star_truth_queries()})"
HITS_SQL = f"""gold AS (SELECT DISTINCT query_id, cand_id FROM truth),
hits AS (
  SELECT p.query_id, p.cand_id, p.rank, CASE WHEN g.cand_id IS NULL THEN 0 ELSE 1 END AS hit,
         sum(CASE WHEN g.cand_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.query_id ORDER BY p.rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hits
  FROM preds p LEFT JOIN gold g ON g.query_id = p.query_id AND g.cand_id = p.cand_id)"""


def _star_eval(spark, sf):
    lake, preds = star_predictions(spark, sf)
    run = lake.key_columns().select(F.col("table_id").alias("query_id")).distinct()
    return preds, run, T.star_truth(spark, sf), T.star_truth_queries(spark)


# ---- J10 + W6 ------------------------------------------------------------------
@register("hits_join", f"""WITH {table_search_ctes()}, {TRUTH}, {HITS_SQL}
SELECT query_id, cand_id, rank, hit, CAST(cum_hits AS BIGINT) AS cum_hits, round(cum_hits / rank, 6) AS prec FROM hits""")
def hits_join(spark, sf):
    preds, _, truth, _ = _star_eval(spark, sf)
    h = E.hits(preds, truth, DEFAULT_K)
    return h.select("query_id", "cand_id", "rank", "hit", F.col("cum_hits").cast("long").alias("cum_hits"), r6("prec"))


M1_SQL = f"""{HITS_SQL},
agg AS (SELECT query_id, sum(hit) AS hits, sum(cum_hits / rank) AS psum FROM hits GROUP BY query_id),
gsize AS (SELECT tq.query_id, count(DISTINCT t.cand_id) AS gold_size FROM truthq tq
          LEFT JOIN truth t ON t.query_id = tq.query_id GROUP BY tq.query_id),
m1 AS (
  SELECT r.query_id, {DEFAULT_K} AS k, coalesce(a.hits, 0) / {float(DEFAULT_K)} AS p_at_k,
         coalesce(a.hits, 0) / greatest(g.gold_size, 1) AS r_at_k, coalesce(a.psum, 0.0) / {float(DEFAULT_K)} AS ap_at_k,
         CAST(g.gold_size AS BIGINT) AS gold_size, CAST(coalesce(a.hits, 0) AS BIGINT) AS hits
  FROM runq r JOIN gsize g ON g.query_id = r.query_id LEFT JOIN agg a ON a.query_id = r.query_id)"""


# ---- M1 -----------------------------------------------------------------------
@register("metrics_at_k", f"""WITH {table_search_ctes()}, {TRUTH}, {M1_SQL}
SELECT query_id, k, round(p_at_k, 6) AS p_at_k, round(r_at_k, 6) AS r_at_k, round(ap_at_k, 6) AS ap_at_k,
       gold_size, hits FROM m1""")
def metrics_at_k(spark, sf):
    preds, run, truth, tq = _star_eval(spark, sf)
    m = E.metrics_a(preds, run, truth, tq, DEFAULT_K)
    return m.select("query_id", "k", r6("p_at_k"), r6("r_at_k"), r6("ap_at_k"), "gold_size", "hits")


# ---- M2 -----------------------------------------------------------------------
@register("overall_metrics", f"""WITH {table_search_ctes()}, {TRUTH}, {M1_SQL}
SELECT count(*) AS num_queries, CAST(sum(hits) AS BIGINT) AS total_hits, CAST(sum(gold_size) AS BIGINT) AS total_gold,
       round(avg(p_at_k), 6) AS macro_p, round(avg(r_at_k), 6) AS macro_r, round(avg(ap_at_k), 6) AS map,
       round(sum(ap_at_k * gold_size) / greatest(CAST(sum(gold_size) AS DOUBLE), 1.0), 6) AS weighted_map,
       round(sum(hits) / greatest(count(*) * {DEFAULT_K}, 1), 6) AS micro_p,
       round(sum(hits) / greatest(sum(gold_size), 1), 6) AS micro_r, {DEFAULT_K} AS k
FROM m1 HAVING count(*) > 0""")
def overall_metrics(spark, sf):
    preds, run, truth, tq = _star_eval(spark, sf)
    o = E.overall_a(E.metrics_a(preds, run, truth, tq, DEFAULT_K), DEFAULT_K)
    return o.select("num_queries", F.col("total_hits").cast("long").alias("total_hits"),
                    F.col("total_gold").cast("long").alias("total_gold"),
                    *[r6(c) for c in ["macro_p", "macro_r", "map", "weighted_map", "micro_p", "micro_r"]], "k")


def m3_sql(ks=KS) -> str:
    kv = ", ".join(f"({k})" for k in ks)
    return f"""{HITS_SQL.replace('FROM preds p', f'FROM (SELECT * FROM preds WHERE rank <= {max(ks)}) p')},
nrel AS (SELECT query_id, count(DISTINCT cand_id) AS n_rel FROM truth GROUP BY query_id),
npred AS (SELECT query_id, count(*) AS n_pred FROM preds GROUP BY query_id),
qk AS (SELECT r.query_id, n.n_rel, coalesce(p.n_pred, 0) AS n_pred, ks.k, least(ks.k, coalesce(p.n_pred, 0)) AS k_eff
       FROM runq r JOIN nrel n ON n.query_id = r.query_id LEFT JOIN npred p ON p.query_id = r.query_id,
       (VALUES {kv}) ks(k)),
agg AS (SELECT h.query_id, qk.k, sum(h.hit) AS hits, sum(h.cum_hits / h.rank) AS psum,
               max(CASE WHEN h.hit = 1 THEN 1.0 / h.rank END) AS rr
        FROM hits h JOIN qk ON qk.query_id = h.query_id WHERE h.rank <= qk.k_eff GROUP BY h.query_id, qk.k),
m3 AS (SELECT qk.query_id, qk.k,
  CASE WHEN k_eff > 0 THEN coalesce(a.hits, 0) / k_eff ELSE 0.0 END AS p_at_k,
  CASE WHEN k_eff > 0 THEN coalesce(a.hits, 0) / n_rel ELSE 0.0 END AS r_at_k,
  CASE WHEN k_eff > 0 THEN coalesce(a.psum, 0.0) / k_eff ELSE 0.0 END AS map_at_k,
  CASE WHEN k_eff > 0 THEN coalesce(a.rr, 0.0) ELSE 0.0 END AS mrr_at_k
  FROM qk LEFT JOIN agg a ON a.query_id = qk.query_id AND a.k = qk.k)"""


M3_OUT = "SELECT query_id, k, round(p_at_k, 6) AS p_at_k, round(r_at_k, 6) AS r_at_k, round(map_at_k, 6) AS map_at_k, round(mrr_at_k, 6) AS mrr_at_k FROM m3"
M4_OUT = """SELECT k, count(*) AS num_queries, round(avg(p_at_k), 6) AS p_at_k, round(avg(r_at_k), 6) AS r_at_k,
       round(avg(map_at_k), 6) AS map_at_k, round(avg(mrr_at_k), 6) AS mrr_at_k FROM m3 GROUP BY k"""


def _m3_out(m):
    return m.select("query_id", "k", r6("p_at_k"), r6("r_at_k"), r6("map_at_k"), r6("mrr_at_k"))


def _m4_out(a):
    return a.select("k", "num_queries", r6("p_at_k"), r6("r_at_k"), r6("map_at_k"), r6("mrr_at_k"))


# ---- M3 / M4 / K4 over the column-search ranking -------------------------------------
@register("metrics_multi_k", f"WITH {table_search_ctes()}, {TRUTH}, {m3_sql()}\n{M3_OUT}")
def metrics_multi_k(spark, sf):
    preds, run, truth, _ = _star_eval(spark, sf)
    return _m3_out(E.metrics_b(preds, run, truth, KS))


@register("average_metrics", f"WITH {table_search_ctes()}, {TRUTH}, {m3_sql()}\n{M4_OUT}")
def average_metrics(spark, sf):
    preds, run, truth, _ = _star_eval(spark, sf)
    return _m4_out(E.average_b(E.metrics_b(preds, run, truth, KS)))


@register("metric_report", f"""WITH {table_search_ctes()}, {TRUTH}, {m3_sql()},
m4 AS ({M4_OUT})
SELECT k, 'P@' || k || ': ' || printf('%.4f', p_at_k) || ', R@' || k || ': ' || printf('%.4f', r_at_k)
       || ', MAP@' || k || ': ' || printf('%.4f', map_at_k) || ', MRR@' || k || ': ' || printf('%.4f', mrr_at_k) AS line
FROM (SELECT k, avg(p_at_k) AS p_at_k, avg(r_at_k) AS r_at_k, avg(map_at_k) AS map_at_k, avg(mrr_at_k) AS mrr_at_k
      FROM m3 GROUP BY k)""")
def metric_report(spark, sf):
    preds, run, truth, _ = _star_eval(spark, sf)
    return E.metric_lines(E.average_b(E.metrics_b(preds, run, truth, KS)))
