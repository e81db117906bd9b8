"""Contrastive losses as evaluation queries over embedding tables (J11-J13,
L1-L3, A11).  No gradients: these score a fixed encoder.

Inputs: ``samples(sample_idx, batch_id, row_vec, desc_vec)``,
``centroids(layer, cluster_id, vec)``, ``assignments(layer, sample_idx, cluster_id)``.
All pair sets are bounded: within a batch (B x B) or row x centroid of a layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.functions.vectors import dot, l2_normalize, norm
from lakejoin.operators.similarity import blocks_for

TEMPERATURE = 0.05
BLOCK_ROWS = 1024   # rows or centroids of one block
ALPHA = 1.0
BETA = 1.0


def _unit(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_n", norm(F.col(col))).withColumn(col, l2_normalize(F.col(col), F.col("_n"))).drop("_n")


def key_loss(samples: DataFrame, tau: float = TEMPERATURE) -> DataFrame:
    """L1 (+J11): per batch, mean over rows i of
    log sum_j exp(cos(h_i, h'_j)/tau) - cos(h_i, h'_i)/tau."""
    s = _unit(_unit(samples.select("sample_idx", "batch_id", "row_vec", "desc_vec"), "row_vec"), "desc_vec")
    a = s.select("batch_id", F.col("sample_idx").alias("i"), "row_vec")
    b = s.select("batch_id", F.col("sample_idx").alias("j"), "desc_vec")
    logits = a.join(b, "batch_id").withColumn("l", dot(F.col("row_vec"), F.col("desc_vec")) / F.lit(tau))
    per_i = logits.groupBy("batch_id", "i").agg(
        F.log(F.sum(F.exp("l"))).alias("lse"), F.max(F.when(F.col("i") == F.col("j"), F.col("l"))).alias("own"))
    return per_i.groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("own")).alias("key_loss"))


def centroid_loss(samples: DataFrame, centroids: DataFrame, assignments: DataFrame,
                  tau: float = TEMPERATURE, row_blocks: int | None = None, centroid_blocks: int | None = None) -> DataFrame:
    """L2 (+J12, J13): per batch, the mean over valid layers of the mean over
    rows of the cross entropy against the row's own cluster (label looked up
    by sample index, 0 when missing, clamped to [0, C-1]); 0 with no layer.

    The row x centroid softmax is computed block-wise (co-grouped row and
    centroid blocks per layer, numpy inside): each task returns, per row, the
    partial sum of exp(logit) over its centroids and the own logit when the
    label falls in its block; partial sums are added afterwards, so no
    row x centroid pair set is ever materialised."""
    import numpy as np
    import pandas as pd

    s = _unit(samples.select("sample_idx", "batch_id", "row_vec"), "row_vec")
    c = _unit(centroids.select("layer", "cluster_id", "vec"), "vec")
    # rows x layers: (layer, #centroids) is a handful of ints, passed as literals
    n_c = {int(r[0]): int(r[1]) for r in c.groupBy("layer").agg(F.count(F.lit(1))).collect()}
    # block counts follow the numbers of samples and centroids unless given
    row_blocks = row_blocks or blocks_for(s.count(), BLOCK_ROWS)
    centroid_blocks = centroid_blocks or blocks_for(max(n_c.values(), default=1), BLOCK_ROWS)
    sl = s.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in sorted(n_c)]) if n_c
                                         else F.array().cast("array<int>")))
    ncol = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(n_c.items()) for x in kv]), F.col("layer")) \
        if n_c else F.lit(0)
    lab = (sl.join(assignments.select("layer", "sample_idx", F.col("cluster_id").alias("y")), ["layer", "sample_idx"], "left")
           .withColumn("y", F.least(F.greatest(F.coalesce("y", F.lit(0)), F.lit(0)), ncol - 1)))
    rows = (lab.select("layer", "sample_idx", "batch_id", "y", F.col("row_vec").alias("vec"))
            .withColumn("rb", F.pmod(F.xxhash64("sample_idx"), F.lit(row_blocks)).cast("int"))
            .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(centroid_blocks - 1)))))
    cents = (c.withColumn("cb", F.pmod(F.xxhash64("cluster_id"), F.lit(centroid_blocks)).cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))))
    inv_tau = 1.0 / tau

    def fn(rp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if rp.empty or cp.empty:
            return pd.DataFrame({"layer": [], "sample_idx": [], "batch_id": [], "sexp": [], "own": []})
        R = np.stack([np.asarray(x, dtype=np.float64) for x in rp["vec"]])
        C = np.stack([np.asarray(x, dtype=np.float64) for x in cp["vec"]])
        logits = (R @ C.T) * inv_tau
        cid = cp["cluster_id"].to_numpy()
        y = rp["y"].to_numpy()
        hit = cid[None, :] == y[:, None]
        own = np.where(hit.any(axis=1), np.where(hit, logits, -np.inf).max(axis=1), np.nan)
        return pd.DataFrame({"layer": rp["layer"].to_numpy(), "sample_idx": rp["sample_idx"].to_numpy(),
                             "batch_id": rp["batch_id"].to_numpy(), "sexp": np.exp(logits).sum(axis=1), "own": own})

    part = (rows.groupBy("layer", "rb", "cb").cogroup(cents.groupBy("layer", "rb", "cb"))
            .applyInPandas(fn, "layer int, sample_idx long, batch_id long, sexp double, own double"))
    per = part.groupBy("batch_id", "layer", "sample_idx").agg(
        F.log(F.sum("sexp")).alias("lse"), F.max("own").alias("own"))
    per_layer = per.groupBy("batch_id", "layer").agg(F.avg(F.col("lse") - F.col("own")).alias("ll"))
    out = per_layer.groupBy("batch_id").agg(F.avg("ll").alias("cent_loss"))
    batches = s.select("batch_id").distinct()
    return batches.join(out, "batch_id", "left").select("batch_id", F.coalesce("cent_loss", F.lit(0.0)).alias("cent_loss"))


def overall_loss(key: DataFrame, cent: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """L3: alpha * L1 + beta * L2 per batch, with the breakdown."""
    return key.join(cent, "batch_id").select(
        "batch_id", (F.lit(alpha) * F.col("key_loss") + F.lit(beta) * F.col("cent_loss")).alias("total_loss"),
        "key_loss", "cent_loss")


def epoch_loss(per_batch: DataFrame) -> DataFrame:
    """Mean of the batch losses and the batch count."""
    return per_batch.agg(F.avg("total_loss").alias("total_loss"), F.avg("key_loss").alias("key_loss"),
                         F.avg("cent_loss").alias("cent_loss"), F.count(F.lit(1)).alias("n_batches"))
