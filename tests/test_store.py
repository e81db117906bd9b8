"""The embedding store: shared, bucketed, re-encoded for changed tables only."""

from pyspark.sql import functions as F

from lakejoin.lake import Lake, tables_from_parts
from lakejoin.operators.encode import column_embeddings_hash
from lakejoin.operators.profile import column_text
from lakejoin.operators.store import EmbeddingStore, fingerprints
from lakejoin.plans.flows import lake_column_embeddings, stored_column_embeddings


def small_lake(spark, tables):
    cells = spark.createDataFrame([(t, r, c, n, v) for t, cols in tables.items() for c, (n, vs) in enumerate(cols.items()) for r, v in enumerate(vs)],
                                  "table_id string, row_idx long, col_idx int, col_name string, value string")
    columns = spark.createDataFrame([(t, c, n, None, 0 if c == 0 else None) for t, cols in tables.items() for c, n in enumerate(cols)],
                                    "table_id string, col_idx int, col_name string, description string, key_pos int")
    pos = spark.createDataFrame([(t, i) for i, t in enumerate(tables)], "table_id string, table_pos long")
    return Lake(tables_from_parts(columns, cells, pos), columns, cells)


ONE = {"a": {"x": ["red", "blue"], "y": ["1", None]}, "b": {"x": ["red", "green"]}, "c": {"z": ["tree"]}}


def rows(df):
    return sorted((r.table_id, r.col_name, r.dim, r.w) for r in df.collect())


def test_only_changed_tables_are_encoded(spark, tmp_path):
    asked = []

    def encode(lake):
        asked.append(sorted(r.table_id for r in lake.tables.collect()))
        return column_embeddings_hash(column_text(lake), 64).withColumn("norm", F.lit(1.0))

    store = EmbeddingStore(spark, "small", root=str(tmp_path), buckets=3)
    assert store.rows().count() == 0
    lake = small_lake(spark, ONE)
    assert store.refresh(lake, encode) == 3 and store.refresh(lake, encode) == 0
    two = {**ONE, "b": {"x": ["red", "gold"]}, "d": {"q": ["new"]}}
    del two["c"]
    lake2 = small_lake(spark, two)
    assert store.refresh(lake2, encode) == 2
    assert asked == [["a", "b", "c"], ["b", "d"]]
    assert rows(store.rows()) == rows(lake_column_embeddings(lake2, 64))
    again = EmbeddingStore(spark, "small", root=str(tmp_path), buckets=3)
    spark.sql(f"DROP TABLE {again.table}")             # as in a new session
    assert rows(again.rows()) == rows(lake_column_embeddings(lake2, 64))
    # back to the first lake: c was dropped, so it is encoded again; a never was
    assert store.refresh(lake, encode) == 2 and asked[-1] == ["b", "c"]
    assert rows(store.rows()) == rows(lake_column_embeddings(lake, 64))


def test_a_refresh_that_fails_changes_nothing(spark, tmp_path):
    store = EmbeddingStore(spark, "small", root=str(tmp_path), buckets=2)
    encode = lambda lake: column_embeddings_hash(column_text(lake), 64).withColumn("norm", F.lit(1.0))
    lake = small_lake(spark, ONE)
    store.refresh(lake, encode)
    before = rows(store.rows())

    def stops(part):
        return encode(part).withColumn("w", F.when(F.rand() >= 0, F.raise_error("stopped").cast("long")))

    try:
        store.refresh(small_lake(spark, {**ONE, "e": {"x": ["1"]}}), stops)
        raise AssertionError("it did not stop")
    except Exception as e:
        assert "stopped" in str(e)
    assert rows(store.rows()) == before
    assert store.refresh(small_lake(spark, {**ONE, "e": {"x": ["1"]}}), encode) == 1


def test_fingerprints_follow_the_content(spark):
    fp = lambda t: {r.table_id: r.fp for r in fingerprints(small_lake(spark, t)).collect()}
    base = fp(ONE)
    assert base == fp(dict(reversed(ONE.items())))
    for other in ({"x": ["blue", "red"], "y": ["1", None]}, {"x": ["red", "blue"], "y": ["1", ""]}, {"x": ["red", "blue"], "yy": ["1", None]}):
        now = fp({**ONE, "a": other})
        assert now["a"] != base["a"] and now["b"] == base["b"]


def test_reading_needs_no_exchange_of_the_embeddings(spark, tmp_path):
    emb = stored_column_embeddings(small_lake(spark, ONE), "plan", 64, root=str(tmp_path))
    emb.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # else the manifest is broadcast
    try:
        per = emb.groupBy("table_id", "col_name").agg(F.sum("w"))
        plan = per._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("HashAggregate"):]
    assert "Bucketed: true" in plan and "SelectedBucketsCount" in plan
    assert scan.count("Exchange hashpartitioning") == 1, scan          # the manifest's
    assert emb.where("abs(norm * norm - 1) < 0").count() == 0
