from pyspark.sql import functions as F

from lakejoin.operators import profile as P
from lakejoin.operators.order import global_index


def test_wide_rows_keep_their_index(spark):
    """Rows so wide that a plan without their payload is partitioned otherwise: none is lost."""
    n = 60000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 40).alias("payload"))
    got = global_index(df, [F.col("k")])
    row = got.agg(F.count("*"), F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.sum((F.col("idx") != F.col("k")).cast("int"))).first()
    assert tuple(row) == (n, n, 0, n - 1, 0)


def test_whole_ranking_equals_the_window(spark):
    cells = spark.range(4000).select(F.lit("t").alias("table_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("col_name"),
                                     F.repeat(F.md5((F.col("id") % 700).cast("string")), 100).alias("value"), F.col("id").alias("row_idx"))
    freq = P.value_frequency(cells)
    key = ["table_id", "col_name", "value", "rn"]
    want = sorted(map(tuple, P.rank_values(freq).select(*key).collect()))
    assert sorted(map(tuple, P.rank_all_values(freq).select(*key).collect())) == want


def test_tasks_of_the_sort_grow_with_the_rows(spark, monkeypatch):
    """With the number of rows known, a task sorts some of them only; ties, NULL and the order stay."""
    from pyspark.sql import functions as F

    from lakejoin.operators import order
    df = spark.range(6000).select(F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(97))).alias("k"), "id")
    by = [F.col("k"), F.col("id")]
    want = [tuple(r) for r in order.global_index(df, by).orderBy("idx").collect()]
    monkeypatch.setattr(order, "SORT_ROWS", 200)
    found = order.global_index(df, by, rows=6000)
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 20 and max(sizes) < 600
    assert [tuple(r) for r in found.orderBy("idx").collect()] == want
