"""Order statistics of the implicit matrix, and versioned centroids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejoin.operators.cluster import matrix_stats
from lakejoin.operators.loss import centroid_loss
from lakejoin.operators.refresh import ClusterStore
from lakejoin.plans.training import cluster_descriptions, evaluate_contrastive


@pytest.mark.parametrize("blocks, buckets", [(1, 1024), (3, 4), (4, 2)])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_matrix_stats_equal_numpy(spark, blocks, buckets, n):
    x = np.random.default_rng(n).integers(-5, 6, (n, 3)).astype(float)          # whole numbers: exact, many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<double>")
    s = -((x[:, None] - x[None]) ** 2).sum(2)
    assert matrix_stats(df, blocks, buckets) == (n * n, s.min(), np.median(s))


def test_matrix_stats_of_nothing_and_of_copies(spark):
    df = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(9)], "idx long, vec array<double>")
    assert matrix_stats(df) == (81, 0.0, 0.0)
    assert matrix_stats(df.limit(0))[0] == 0


def clusters(spark, x):
    return (spark.createDataFrame([(1, 0, [x, 0.0]), (1, 1, [0.0, x])], "layer int, cluster_id int, vec array<double>"),
            spark.createDataFrame([(1, i, i % 2) for i in range(6)], "layer int, sample_idx long, cluster_id int"))


def test_versions(spark, tmp_path):
    store = ClusterStore(spark, str(tmp_path))
    assert store.version() is None and store.centroids().count() == store.assignments().count() == 0
    seen = []
    for x in (1.0, 2.0):
        store.refresh(lambda last: seen.append(last) or clusters(spark, x))
    assert seen == [None, 1] and store.version()[0] == 2
    assert {(r.cluster_id, tuple(r.vec), r.version) for r in store.centroids().collect()} == {(0, (2.0, 0.0), 2), (1, (0.0, 2.0), 2)}

    def stops(last):
        c, a = clusters(spark, 3.0)
        return c, a.withColumn("cluster_id", F.raise_error("stopped").cast("int"))

    with pytest.raises(Exception, match="stopped"):
        store.refresh(stops)
    again = ClusterStore(spark, str(tmp_path))
    assert again.version()[0] == 2 and again.centroids().agg(F.max(F.col("vec")[0])).first()[0] == 2.0
    assert again.refresh(lambda last: clusters(spark, 4.0)[::-1]) == 3
    assert again.assignments().count() == 6


def test_clusters_of_descriptions_feed_the_losses(spark, tmp_path):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(v) for v in rng.normal(i % 3 * 4, 0.1, 2)]) for i in range(12)]
    desc = spark.createDataFrame(vecs, "idx long, vec array<double>")
    store = ClusterStore(spark, str(tmp_path))
    assert cluster_descriptions(store, desc, 2) == 1
    assert store.centroids().select("layer").distinct().count() == 2 and store.assignments().count() == 24
    samples = desc.select(F.col("idx").alias("sample_idx"), (F.col("idx") % 2).alias("batch_id"), F.col("vec").alias("row_vec"), F.col("vec").alias("desc_vec"))
    got = {r.batch_id: r for r in evaluate_contrastive(samples, store).collect()}
    assert set(got) == {0, 1} and all(abs(r.total_loss - r.key_loss - r.cent_loss) < 1e-12 for r in got.values())
    none = centroid_loss(samples, store.centroids().limit(0), store.assignments())
    assert {r.cent_loss for r in none.collect()} == {0.0}


def test_matrix_blocks_grow_with_the_vectors():
    """What is sent is a copy of each vector a block of the other side: their number is bounded by the task slots."""
    from lakejoin.operators.cluster import MATRIX_BLOCK, matrix_blocks
    assert [matrix_blocks(n, 12) for n in (1, 1024, 5000, 20_000, 100_000, 600_000)] == [1, 1, 5, 10, 10, 10]
    assert matrix_blocks(100 * MATRIX_BLOCK, 12) == 100


@pytest.mark.parametrize("blocks", [1, 2])
def test_matrix_stats_by_tiles(spark, monkeypatch, blocks):
    """Several tiles a block, on and off the diagonal: the same count, least value and median."""
    from lakejoin.operators import cluster
    monkeypatch.setattr(cluster, "MATRIX_TILE", 7)
    x = np.random.default_rng(9).integers(-9, 9, (60, 3)).astype(float)
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<double>")
    assert matrix_stats(df, blocks, 4) == (3600, s.min(), np.median(s))
