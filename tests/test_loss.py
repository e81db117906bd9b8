"""Block-wise centroid softmax is invariant to the block counts and equals a
numpy computation."""

import numpy as np
from pyspark.sql import functions as F

from lakejoin.operators import loss as L


def test_centroid_loss_blocks(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(20, 4)); C = rng.normal(size=(5, 4)); y = rng.integers(0, 7, size=20)
    s = spark.createDataFrame([(i, i // 8, [float(v) for v in X[i]]) for i in range(20)],
                              "sample_idx long, batch_id long, row_vec array<double>")
    c = spark.createDataFrame([(1, j, [float(v) for v in C[j]]) for j in range(5)], "layer int, cluster_id int, vec array<double>")
    a = spark.createDataFrame([(1, i, int(y[i])) for i in range(19)], "layer int, sample_idx long, cluster_id int")
    got1 = {r.batch_id: r.cent_loss for r in L.centroid_loss(s, c, a).collect()}
    got2 = {r.batch_id: r.cent_loss for r in L.centroid_loss(s, c, a, row_blocks=3, centroid_blocks=2).collect()}
    Xu = X / np.linalg.norm(X, axis=1, keepdims=True); Cu = C / np.linalg.norm(C, axis=1, keepdims=True)
    lg = Xu @ Cu.T / L.TEMPERATURE
    lab = np.clip(np.r_[y[:19], 0], 0, 4)
    per = np.log(np.exp(lg).sum(1)) - lg[np.arange(20), lab]
    exp = {b: per[np.arange(20) // 8 == b].mean() for b in range(3)}
    for b in exp:
        assert abs(got1[b] - exp[b]) < 1e-9 and abs(got2[b] - exp[b]) < 1e-9
    _ = F
