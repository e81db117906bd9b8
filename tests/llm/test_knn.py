import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejoin.llm import knn

from llm_data import DATA


def brute(rows, k, every):
    ids = sorted({i for i, _ in rows})
    vec = dict(rows)
    out = {}
    for q in ids:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vec[q], vec[i])), i) for i in ids if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def result(df, k, every):
    got = {}
    for r in knn.top_k(df, df.filter(F.col("id") % every == 0), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_embeddings(spark):
    df = knn.quantised(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "embedding").limit(400)
    rows = [(r["id"], list(r["v"])) for r in df.collect()]
    assert result(spark.createDataFrame(rows, "id long, v array<bigint>"), 5, 50) == brute(rows, 5, 50)


@pytest.mark.parametrize("block", [16384, 7])
def test_clusters_ties_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES", block)
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (6, 5))
    rows = [(int(i), [int(x) for x in centres[i % 6] + rng.integers(-3, 4, 5)]) for i in range(150)]
    rows += [(1000 + i, [7, 7, 7, 7, 7]) for i in range(60)] + [(2000, [0] * 5), (2010, [0] * 5)]
    assert result(spark.createDataFrame(rows, "id long, v array<bigint>"), 5, 10) == brute(rows, 5, 10)


@pytest.mark.parametrize("centre", [0.0, 1e3, 1e6])
def test_large_components_close_together(spark, centre):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in centre + rng.normal(0, 0.02, 16)]) for i in range(300)]
    df = knn.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    assert result(df, 5, 5) == brute([(r["id"], list(r["v"])) for r in df.collect()], 5, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, None), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [2.0]), (5, [2.0]), (6, [])]
    df = knn.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = result(df, 5, 5)
    assert got == {0: [(5, 256 * 512), (6, 0)], 5: [(0, 512 * 256), (6, 0)]}
    assert knn.top_k(df.limit(0), df.limit(0), 5).count() == 0
    assert knn.top_k(df, df.limit(0), 5).count() == 0
