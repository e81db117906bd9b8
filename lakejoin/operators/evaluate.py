"""Ranking evaluation.

Inputs are relations: ``predictions(query_id, cand_id, rank)``, the gold set
``truth(query_id, cand_id)`` and ``truth_queries(query_id)`` (queries that
have a truth entry, even an empty one).  Window groups are bounded by K: the
ranking is cut to ``rank <= max(K)`` before any window runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(pred: DataFrame, truth: DataFrame, max_rank: int | None = None) -> DataFrame:
    """J10 + W6: hit flag, running hits and precision at each rank."""
    gold = truth.select("query_id", "cand_id").distinct().withColumn("_gold", F.lit(1))
    p = pred.select("query_id", "cand_id", "rank")
    if max_rank is not None:
        p = p.where(F.col("rank") <= max_rank)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (p.join(gold, ["query_id", "cand_id"], "left")
            .withColumn("hit", F.coalesce(F.col("_gold"), F.lit(0))).drop("_gold")
            .withColumn("cum_hits", F.sum("hit").over(w))
            .withColumn("prec", F.col("cum_hits") / F.col("rank")))


def gold_sizes(truth: DataFrame, truth_queries: DataFrame) -> DataFrame:
    g = truth.select("query_id", "cand_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_size"))
    return (truth_queries.select("query_id").distinct().join(g, "query_id", "left")
            .select("query_id", F.coalesce("gold_size", F.lit(0)).alias("gold_size")))


def metrics_a(pred: DataFrame, run_queries: DataFrame, truth: DataFrame, truth_queries: DataFrame,
              k: int) -> DataFrame:
    """M1: per query with a truth entry (and a prediction run): hits/k,
    hits/|gold|, and the sum of precision at every rank <= k divided by k."""
    h = hits(pred, truth, k).groupBy("query_id").agg(
        F.sum("hit").alias("hits"), F.sum("prec").alias("psum"))
    kk = float(max(k, 1))
    evaluated = run_queries.select("query_id").distinct().join(gold_sizes(truth, truth_queries), "query_id")
    return (evaluated.join(h, "query_id", "left")
            .select("query_id", F.lit(k).alias("k"),
                    (F.coalesce("hits", F.lit(0)) / F.lit(kk)).alias("p_at_k"),
                    (F.coalesce("hits", F.lit(0)) / F.greatest("gold_size", F.lit(1))).alias("r_at_k"),
                    (F.coalesce("psum", F.lit(0.0)) / F.lit(kk)).alias("ap_at_k"),
                    F.col("gold_size").cast("long").alias("gold_size"),
                    F.coalesce("hits", F.lit(0)).cast("long").alias("hits")))


def overall_a(per_query: DataFrame, k: int) -> DataFrame:
    """M2: macro P/R, MAP, gold-weighted MAP, micro P/R and totals (one row;
    no row when nothing was evaluated)."""
    n = F.count(F.lit(1))
    th, tg = F.sum("hits"), F.sum("gold_size")
    return (per_query.agg(
        n.alias("num_queries"), th.alias("total_hits"), tg.alias("total_gold"),
        F.avg("p_at_k").alias("macro_p"), F.avg("r_at_k").alias("macro_r"), F.avg("ap_at_k").alias("map"),
        (F.sum(F.col("ap_at_k") * F.col("gold_size")) / F.greatest(tg.cast("double"), F.lit(1.0))).alias("weighted_map"),
        (th / F.greatest(n * F.lit(k), F.lit(1))).alias("micro_p"),
        (th / F.greatest(tg, F.lit(1))).alias("micro_r"))
        .where(F.col("num_queries") > 0)
        .withColumn("k", F.lit(k)))


def metrics_b(ranking: DataFrame, run_queries: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """M3 (+W7): for each query with a non-empty gold set and each K:
    K_eff = min(K, #predictions); P = hits/K_eff, R = hits/|gold|,
    MAP = sum of precision at ranks <= K_eff / K_eff, MRR = 1/first hit rank;
    zeros when the query has no prediction."""
    ks = sorted({int(x) for x in ks if int(x) > 0})
    max_k = max(ks)
    gold = truth.select("query_id", "cand_id").distinct()
    n_rel = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    n_pred = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pred"))
    qk = (run_queries.select("query_id").distinct().join(n_rel, "query_id")
          .join(n_pred, "query_id", "left")
          .withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
          .withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks])))
          .withColumn("k_eff", F.least("k", "n_pred")))
    h = hits(ranking, truth, max_k)
    agg = (h.join(qk.select("query_id", "k", "k_eff"), "query_id")
           .where(F.col("rank") <= F.col("k_eff"))
           .groupBy("query_id", "k").agg(
               F.sum("hit").alias("hits"), F.sum("prec").alias("psum"),
               F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr")))
    out = qk.join(agg, ["query_id", "k"], "left")
    keff = F.col("k_eff")
    z = F.lit(0.0)
    return out.select(
        "query_id", "k",
        F.when(keff > 0, F.coalesce("hits", F.lit(0)) / keff).otherwise(z).alias("p_at_k"),
        F.when(keff > 0, F.coalesce("hits", F.lit(0)) / F.col("n_rel")).otherwise(z).alias("r_at_k"),
        F.when(keff > 0, F.coalesce("psum", z) / keff).otherwise(z).alias("map_at_k"),
        F.when(keff > 0, F.coalesce("rr", z)).otherwise(z).alias("mrr_at_k"))


def average_b(per_query: DataFrame) -> DataFrame:
    """Mean of each metric over the counted queries, per K."""
    return per_query.groupBy("k").agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.avg("p_at_k").alias("p_at_k"), F.avg("r_at_k").alias("r_at_k"),
        F.avg("map_at_k").alias("map_at_k"), F.avg("mrr_at_k").alias("mrr_at_k"))


def metric_lines(avg: DataFrame) -> DataFrame:
    """K4: printable summary, four decimals."""
    from lakejoin.functions.text import fmt_dec
    f = lambda c: fmt_dec(F.col(c), 4)
    return avg.select("k", F.concat(
        F.lit("P@"), F.col("k").cast("string"), F.lit(": "), f("p_at_k"),
        F.lit(", R@"), F.col("k").cast("string"), F.lit(": "), f("r_at_k"),
        F.lit(", MAP@"), F.col("k").cast("string"), F.lit(": "), f("map_at_k"),
        F.lit(", MRR@"), F.col("k").cast("string"), F.lit(": "), f("mrr_at_k")).alias("line"))
