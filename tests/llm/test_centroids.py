import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejoin.llm import centroids


def brute(rows, k, dim, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*m)] if (m := [v for (_, v), g in zip(kept, got) if g == j]) else c[j] for j in range(len(c))]
    done = [(i, *near(v)) for i, v in kept]
    per = {}
    for _, d, j in done:
        per[j] = per.get(j, 0) + d
    return sorted((i is None, i or 0, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in done)


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, *list(r)[1:]) for r in centroids.cluster(df.repartition(3), **kw).collect())


@pytest.mark.parametrize("k", [3, 16, 40])
def test_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    middles = rng.integers(-3, 4, (7, 5))
    rows = [(i, [float(x) for x in middles[i % 7] + rng.integers(-1, 2, 5) / 2]) for i in range(160)]    # many ties and copies
    kw = dict(k=k, dim=5, rounds=3, scale=4)
    assert result(spark, rows, **kw) == brute(rows, **kw)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]), (6, [1e6, -1e6]), (6, [1e6, -1e6]), (7, [-0.3, 0.3]), (8, [])]
    kw = dict(k=2, dim=2, rounds=2, scale=64)
    assert result(spark, rows, **kw) == brute(rows, **kw)
    assert result(spark, [], **kw) == result(spark, rows[:5], **kw) == []
    with pytest.raises(ValueError):
        result(spark, [(1, [1e30, 0.0])], **kw)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(0)
    c = rng.integers(-100, 100, (200, 3))
    c = np.concatenate([c, c[:50]])                       # equal centroids: the smaller number wins
    x = rng.integers(-120, 120, (500, 3))
    arg, best, tested = centroids.nearest(centroids.build(c), x)
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (arg == d.argmin(1)).all() and (best == d.min(1)).all()
    assert tested < 0.5 * d.size
    far = c + (1 << 26)                                   # large values, small differences
    arg, best, _ = centroids.nearest(centroids.build(far), x + (1 << 26))
    assert (arg == d.argmin(1)).all() and (best == d.min(1)).all()
