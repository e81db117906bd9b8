"""Clustering and loss queries.

Samples come from the vector lake: each embedding is one sample, its first
32 dimensions the "row" view and its last 32 the "description" view (two
views of the same item, as the key-wise loss needs).  Clustering runs on the
description view, as in the reference's training loop.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakejoin.operators import cluster as CL
from lakejoin.operators import loss as L
from lakejoin.operators.order import DEFAULT_SEED, batches, seeded_key
from lakejoin.plans.registry import r6, register
from lakejoin.sources import testdata as T

HALF = 32
LOSS_BATCH = 32
SEED = DEFAULT_SEED

SAMPLES_SQL = f"""smp AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS sample_idx, label,
                 CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
views AS (SELECT sample_idx, label, v[1:{HALF}] AS row_v, v[{HALF + 1}:{2 * HALF}] AS desc_v FROM smp)"""


def samples(spark, sf):
    e = T.read(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    from lakejoin.operators.order import global_index
    s = global_index(e.select("vec_id", "label", v.alias("v")), [F.col("vec_id")], "sample_idx")
    return s.select("sample_idx", "label", F.slice("v", 1, HALF).alias("row_vec"),
                    F.slice("v", HALF + 1, HALF).alias("desc_vec"))


def desc_vectors(spark, sf):
    return samples(spark, sf).select(F.col("sample_idx").alias("idx"), F.col("desc_vec").alias("vec"))


EDGES_SQL = """edges AS (SELECT a.sample_idx AS i, b.sample_idx AS k,
                  -list_sum(list_transform(list_zip(a.desc_v, b.desc_v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS s
           FROM views a, views b)"""


# ---- H1 + A7 ---------------------------------------------------------------------
@register("sq_distance_stats", f"""WITH {SAMPLES_SQL}, {EDGES_SQL}
SELECT count(*) AS n_pairs, round(min(s), 6) AS min_s, round(median(s), 6) AS median_s FROM edges""")
def sq_distance_stats(spark, sf):
    n, mn, med = CL.matrix_stats(desc_vectors(spark, sf))
    return spark.createDataFrame([(n, mn, med)], "n_pairs long, min_s double, median_s double") \
        .select("n_pairs", r6("min_s"), r6("median_s"))


# ---- H2 ------------------------------------------------------------------------
@register("preference_schedule", f"""WITH {SAMPLES_SQL}, {EDGES_SQL},
st AS (SELECT min(s) AS mn, median(s) AS med FROM edges)
SELECT CAST(l.layer AS INTEGER) AS layer, round(mn + (med - mn) / {CL.N_LAYERS - 1} * (l.layer - 1), 6) AS preference
FROM st, range(1, {CL.N_LAYERS + 1}) l(layer)""")
def preference_schedule(spark, sf):
    _, mn, med = CL.matrix_stats(desc_vectors(spark, sf))
    prefs = CL.preferences(mn, med, CL.N_LAYERS)
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(prefs)], "layer int, preference double") \
        .select("layer", r6("preference"))


# ---- H4 fallback centroid ----------------------------------------------------------
@register("cluster_fallback_mean", f"""WITH {SAMPLES_SQL}
SELECT CAST(u.d - 1 AS INTEGER) AS d, round(avg(u.x), 6) AS x FROM views, unnest(desc_v) WITH ORDINALITY AS u(x, d) GROUP BY u.d""")
def cluster_fallback_mean(spark, sf):
    v = desc_vectors(spark, sf)
    return v.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).select(
        F.col("d").cast("int").alias("d"), r6("x"))


# ---- H3 / H5 / H6 / A8 (iterative: checked against a numpy run in tests/) ----------------------
def _clusters(spark, sf):
    return CL.hierarchical_clusters(desc_vectors(spark, sf), CL.N_LAYERS)


@register("affinity_clusters")
def affinity_clusters(spark, sf):
    a, c, s = _clusters(spark, sf)
    return s.select("layer", "n_clusters", "n_iterations", "converged", r6("preference"))


@register("cluster_sizes")
def cluster_sizes(spark, sf):
    a, _, _ = _clusters(spark, sf)
    return CL.cluster_sizes(a)


# ---- L1 / L2 / L3 / A11 -----------------------------------------------------------------
def loss_samples(spark, sf):
    s = samples(spark, sf)
    return batches(s, LOSS_BATCH, [seeded_key(SEED, "sample_idx"), F.col("sample_idx")])


def label_clustering(s):
    """One layer whose clusters are the embedding labels: centroids = mean
    description view per label, assignment = label (cluster ids dense by label)."""
    cid = F.dense_rank().over(Window.orderBy("label")) - 1
    labs = s.select("label").distinct().withColumn("cluster_id", cid.cast("int"))
    e = s.join(labs, "label").select("cluster_id", "sample_idx", F.posexplode("desc_vec").alias("d", "x"))
    cent = (e.groupBy("cluster_id", "d").agg(F.avg("x").alias("x")).groupBy("cluster_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("vec"))
            .select(F.lit(1).alias("layer"), "cluster_id", "vec"))
    assign = s.join(labs, "label").select(F.lit(1).alias("layer"), "sample_idx", "cluster_id")
    return cent, assign


BATCH_SQL = f"""b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('{SEED}' || '|' || CAST(sample_idx AS VARCHAR)), sample_idx) - 1) / {LOSS_BATCH}) AS BIGINT) AS batch_id FROM views),
u AS (SELECT sample_idx, batch_id, label,
             list_transform(row_v, lambda x: x / greatest(sqrt(list_dot_product(row_v, row_v)), 1e-12)) AS hr,
             list_transform(desc_v, lambda x: x / greatest(sqrt(list_dot_product(desc_v, desc_v)), 1e-12)) AS hd FROM b)"""

L1_SQL = """lg AS (SELECT a.batch_id, a.sample_idx AS i, c.sample_idx AS j, list_dot_product(a.hr, c.hd) / 0.05 AS l
       FROM u a JOIN u c ON a.batch_id = c.batch_id),
l1 AS (SELECT batch_id, avg(lse - own) AS key_loss FROM (
         SELECT batch_id, i, ln(sum(exp(l))) AS lse, max(CASE WHEN i = j THEN l END) AS own FROM lg GROUP BY batch_id, i)
       GROUP BY batch_id)"""

L2_SQL = """labs AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster_id FROM (SELECT DISTINCT label FROM views)),
cent AS (SELECT cluster_id, d, avg(x) AS x FROM views JOIN labs USING (label), unnest(desc_v) WITH ORDINALITY AS t(x, d) GROUP BY ALL),
cvec AS (SELECT cluster_id, list(x ORDER BY d) AS v FROM cent GROUP BY cluster_id),
cu AS (SELECT cluster_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS hc FROM cvec),
nc AS (SELECT count(*) AS n_c FROM cu),
ly AS (SELECT u.batch_id, u.sample_idx, u.hr, least(greatest(coalesce(l.cluster_id, 0), 0), nc.n_c - 1) AS y
       FROM u JOIN labs l ON l.label = u.label, nc),
l2r AS (SELECT ly.batch_id, ly.sample_idx, ln(sum(exp(list_dot_product(ly.hr, cu.hc) / 0.05))) AS lse,
               max(CASE WHEN cu.cluster_id = ly.y THEN list_dot_product(ly.hr, cu.hc) / 0.05 END) AS own
        FROM ly, cu GROUP BY ly.batch_id, ly.sample_idx),
l2 AS (SELECT batch_id, avg(lse - own) AS cent_loss FROM l2r GROUP BY batch_id)"""


@register("key_loss", f"""WITH {SAMPLES_SQL}, {BATCH_SQL}, {L1_SQL}
SELECT batch_id, round(key_loss, 6) AS key_loss FROM l1""")
def key_loss(spark, sf):
    s = loss_samples(spark, sf)
    return L.key_loss(s).select("batch_id", r6("key_loss"))


@register("centroid_loss", f"""WITH {SAMPLES_SQL}, {BATCH_SQL}, {L2_SQL}
SELECT batch_id, round(cent_loss, 6) AS cent_loss FROM l2""")
def centroid_loss(spark, sf):
    s = loss_samples(spark, sf)
    cent, assign = label_clustering(s)
    return L.centroid_loss(s, cent, assign).select("batch_id", r6("cent_loss"))


@register("overall_loss", f"""WITH {SAMPLES_SQL}, {BATCH_SQL}, {L1_SQL}, {L2_SQL}
SELECT l1.batch_id, round(key_loss + cent_loss, 6) AS total_loss, round(key_loss, 6) AS key_loss,
       round(cent_loss, 6) AS cent_loss FROM l1 JOIN l2 USING (batch_id)""")
def overall_loss(spark, sf):
    s = loss_samples(spark, sf)
    cent, assign = label_clustering(s)
    o = L.overall_loss(L.key_loss(s), L.centroid_loss(s, cent, assign))
    return o.select("batch_id", r6("total_loss"), r6("key_loss"), r6("cent_loss"))


@register("epoch_loss", f"""WITH {SAMPLES_SQL}, {BATCH_SQL}, {L1_SQL}, {L2_SQL}
SELECT round(avg(key_loss + cent_loss), 6) AS total_loss, round(avg(key_loss), 6) AS key_loss,
       round(avg(cent_loss), 6) AS cent_loss, count(*) AS n_batches FROM l1 JOIN l2 USING (batch_id)""")
def epoch_loss(spark, sf):
    s = loss_samples(spark, sf)
    cent, assign = label_clustering(s)
    e = L.epoch_loss(L.overall_loss(L.key_loss(s), L.centroid_loss(s, cent, assign)))
    return e.select(r6("total_loss"), r6("key_loss"), r6("cent_loss"), "n_batches")


# ---- H6 versioned refresh, F6 evaluation over several written layers -----------------------------
LAYERS_SQL = """labs AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS r FROM (SELECT DISTINCT label FROM views)),
memb AS (SELECT v.sample_idx, v.desc_v, v.row_v, l.layer, CASE l.layer WHEN 1 THEN labs.r WHEN 2 THEN labs.r % 3 ELSE labs.r % 5 END AS cid
         FROM views v JOIN labs ON labs.label = v.label, (SELECT unnest([1, 2, 3]) AS layer) l),
assigned AS (SELECT layer, sample_idx, cid AS cluster_id FROM memb WHERE layer < 3 OR sample_idx % 2 = 0),
cent AS (SELECT layer, cid AS cluster_id, d, avg(x) AS x FROM memb, unnest(desc_v) WITH ORDINALITY AS t(x, d)
         WHERE layer < 3 OR cid < 2 GROUP BY ALL)"""


def layered_clustering(s, vec: str):
    """Three layers over the labels' ranks: each, modulo 3, and modulo 5.  In the
    third only clusters 0 and 1 have centroids and only samples with an even
    number an assignment, so look-ups are missing or out of range there."""
    rank = (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int")
    labs = s.select("label").distinct().withColumn("r", rank)        # one row a label
    r = F.col("r")
    memb = (s.join(labs, "label").withColumn("layer", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])))
            .withColumn("cluster_id", F.when(F.col("layer") == 1, r).when(F.col("layer") == 2, r % 3).otherwise(r % 5)))
    assign = memb.where("layer < 3 OR sample_idx % 2 = 0").select("layer", "sample_idx", "cluster_id")
    mean = (memb.where("layer < 3 OR cluster_id < 2").select("layer", "cluster_id", F.posexplode(vec).alias("d", "x"))
            .groupBy("layer", "cluster_id", "d").agg(F.avg("x").alias("x")).groupBy("layer", "cluster_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda t: t["x"]).alias("vec")))
    return mean, assign


def refreshed(spark, sf):
    """A cluster store after the first clustering (row views) and the refresh of an epoch (description views)."""
    from lakejoin.operators.refresh import ClusterStore
    s = loss_samples(spark, sf)
    store = ClusterStore(spark)
    for vec in ("row_vec", "desc_vec"):
        store.refresh(lambda previous, v=vec: layered_clustering(s, v))
    return s, store


@register("centroid_refresh", f"""WITH {SAMPLES_SQL}, {LAYERS_SQL},
n AS (SELECT layer, cluster_id, count(*) AS n_samples FROM assigned GROUP BY ALL)
SELECT 2 AS version, CAST(c.layer AS INTEGER) AS layer, CAST(c.cluster_id AS INTEGER) AS cluster_id, n.n_samples, CAST(c.d - 1 AS INTEGER) AS d, round(c.x, 6) AS x
FROM cent c JOIN n ON n.layer = c.layer AND n.cluster_id = c.cluster_id""")
def centroid_refresh(spark, sf):
    _, store = refreshed(spark, sf)
    n = store.assignments().groupBy("layer", "cluster_id").agg(F.count(F.lit(1)).alias("n_samples"))
    return (store.centroids().join(n, ["layer", "cluster_id"])
            .select("version", "layer", "cluster_id", "n_samples", F.posexplode("vec").alias("d", "x"))
            .select("version", "layer", "cluster_id", "n_samples", "d", r6("x")))


@register("contrastive_eval", f"""WITH {SAMPLES_SQL}, {BATCH_SQL}, {L1_SQL}, {LAYERS_SQL},
cvec AS (SELECT layer, cluster_id, list(x ORDER BY d) AS v FROM cent GROUP BY layer, cluster_id),
cu AS (SELECT layer, cluster_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS hc FROM cvec),
nc AS (SELECT layer, count(*) AS n_c FROM cu GROUP BY layer),
ly AS (SELECT u.batch_id, u.sample_idx, u.hr, nc.layer, least(greatest(coalesce(a.cluster_id, 0), 0), nc.n_c - 1) AS y
       FROM u CROSS JOIN nc LEFT JOIN assigned a ON a.layer = nc.layer AND a.sample_idx = u.sample_idx),
l2r AS (SELECT ly.batch_id, ly.layer, ly.sample_idx, ln(sum(exp(list_dot_product(ly.hr, cu.hc) / 0.05))) AS lse,
               max(CASE WHEN cu.cluster_id = ly.y THEN list_dot_product(ly.hr, cu.hc) / 0.05 END) AS own
        FROM ly JOIN cu ON cu.layer = ly.layer GROUP BY ly.batch_id, ly.layer, ly.sample_idx),
l2 AS (SELECT batch_id, avg(ll) AS cent_loss FROM (SELECT batch_id, layer, avg(lse - own) AS ll FROM l2r GROUP BY batch_id, layer) GROUP BY batch_id)
SELECT l1.batch_id, round(key_loss + cent_loss, 6) AS total_loss, round(key_loss, 6) AS key_loss, round(cent_loss, 6) AS cent_loss
FROM l1 JOIN l2 USING (batch_id)""")
def contrastive_eval(spark, sf):
    """F6, second half: L1-L3 per batch over three layers read back from the cluster store."""
    from lakejoin.plans.training import evaluate_contrastive
    s, store = refreshed(spark, sf)
    return evaluate_contrastive(s, store).select("batch_id", r6("total_loss"), r6("key_loss"), r6("cent_loss"))
