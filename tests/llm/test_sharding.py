from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakejoin.llm import sharding


def test_matrix_margins():
    rows, shards = [100, 0, 57, 3, 40], [40] * 5
    m = sharding.matrix(rows, shards, 3)
    assert [sum(r) for r in m] == rows
    assert [sum(c) for c in zip(*m)] == shards


def test_draw_follows_the_hypergeometric_law():
    import math
    good, bad, n = 7, 9, 6
    pmf = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
    steps = 20_000
    got = Counter(sharding.draw(good, bad, n, (i + 0.5) / steps) for i in range(steps))
    for k, p in enumerate(pmf):
        assert abs(got[k] / steps - p) < 2e-3


def test_draw_in_a_large_population():
    x = sharding.draw(10**9, 39 * 10**9, 7_000_000, 0.5)
    assert abs(x - 175_000) < 2_000


def test_exact_sizes_and_gapless_slots(spark):
    df = spark.range(0, 20_011).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(df, 40).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 20_011
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(40))
    assert {len(v) for v in by.values()} == {500, 501}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # neighbours in the input are not neighbours in the output
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 40


def test_same_result_for_other_partitions(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "doc_id")
    a = sharding.shard(df.repartition(7), 5).collect()
    b = sharding.shard(df.repartition(2), 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_hot_key_null_and_empty(spark, odd, empty):
    df = spark.range(0, 900).select(F.when(F.col("id") < 300, F.lit(None).cast("long")).otherwise(F.col("id")).alias("doc_id"))
    rows = sharding.shard(df, 7).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [128] * 3 + [129] * 4
    out = sharding.shard(odd, 3)
    assert out.columns == [*odd.columns, "shard_", "slot_"] and out.count() == odd.count()
    assert sharding.shard(empty, 3).count() == 0


def test_write(spark, tmp_path):
    df = sharding.shard(spark.range(0, 50).withColumnRenamed("id", "doc_id"), 4)
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50


def test_repeated_ids_and_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(i % 40 if i % 5 else None, f"text {i}") for i in range(240)] + [(7, "same")] * 100 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for part in (df.repartition(7), df.coalesce(1), df.orderBy(F.rand(3))):
        got = [tuple(r) for r in sharding.shard(part, 6).collect()]
        assert Counter(r[:2] for r in got) == Counter(rows)
        found.append(sorted(got, key=repr))
    assert found[0] == found[1] == found[2]
    assert len({r[2] for r in found[0] if r[:2] == (7, "same")}) == 6
