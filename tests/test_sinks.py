"""Whole results are one version; shuffled copies are permutations."""

import pytest
from pyspark.sql import functions as F

from lakejoin.operators.pairs import shuffled_cells
from lakejoin.sources import sinks as K

from test_store import ONE, small_lake

RANK = "query_id string, cand_id string, score double, rank long"


def test_result_is_one_version(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        K.read_result(spark, path)
    metrics = spark.createDataFrame([("q", 1, 0.5)], "query_id string, k int, p_at_k double")
    for n in (1, 2):
        ranking = spark.createDataFrame([("q", f"c{n}-{i}", 1.0 / i, i) for i in range(1, 12)], RANK)
        assert K.write_result(ranking, metrics, metrics.drop("query_id"), path, 5) == n
    got = K.read_result(spark, path)
    parts = {r.from_rank: [x["cand_id"] for x in r.results] for r in got["results"].collect()}
    assert parts == {1: [f"c2-{i}" for i in range(1, 6)], 6: [f"c2-{i}" for i in range(6, 11)], 11: ["c2-11"]}
    assert got["avg_metrics"].columns == ["k", "p_at_k"]
    stops = metrics.withColumn("p_at_k", F.raise_error("stopped").cast("double"))
    with pytest.raises(Exception, match="stopped"):
        K.write_result(ranking, metrics, stops, path, 5)
    assert K.read_result(spark, path)["results"].count() == 3


def test_shuffled_copies_are_permutations(spark):
    lake = small_lake(spark, {**ONE, "long": {"v": [f"v{i}" for i in range(50)], "w": ["x"] * 50}})
    got = {}
    for r in shuffled_cells(lake, lake.columns.where("col_name in ('v', 'x')")).collect():
        got.setdefault((r.table_id, r.col_name), {})[r.row_idx] = r.value
    assert set(got) == {("a_shuffled", "x"), ("b_shuffled", "x"), ("long_shuffled", "v")}
    v = got["long_shuffled", "v"]
    assert sorted(v) == list(range(50)) and sorted(v.values()) == sorted(f"v{i}" for i in range(50))
    assert sum(v[i] == f"v{i}" for i in range(50)) < 10
