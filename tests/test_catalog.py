from pyspark.sql import functions as F

from lakejoin.functions.catalog import infer_base_id, infer_partition, split_column_key
from lakejoin.lake import Lake
from lakejoin.operators.catalog import resolve_names


def test_base_and_partition(spark):
    ids = ["abc-top-1", "abc_def-x", "a_b_c", "plain", "t-middle", "t-Top", "x-bottom-y-z"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: (r.b, r.p) for r in df.select("id", infer_base_id(F.col("id")).alias("b"),
                                                infer_partition(F.col("id")).alias("p")).collect()}
    assert got == {"abc-top-1": ("abc", "top"), "abc_def-x": ("abc_def", "unknown"), "a_b_c": ("a", "unknown"),
                   "plain": ("plain", "unknown"), "t-middle": ("t", "middle"), "t-Top": ("t", "unknown"),
                   "x-bottom-y-z": ("x", "bottom")}


def test_split_column_key(spark):
    df = spark.createDataFrame([("t::c",), ("t::c::d",), ("t",), ("::c",)], "k string")
    t, c = split_column_key(F.col("k"))
    got = [(r.t, r.c) for r in df.select(t.alias("t"), c.alias("c")).collect()]
    assert got == [("t", "c"), ("t", "c::d"), ("t", ""), ("", "c")]


def test_resolve_names(spark):
    tables = spark.createDataFrame([("a",), ("f/b",), ("c.csv",)], "table_id string")
    names = spark.createDataFrame([(0, "a"), (1, "a.csv"), (2, "f\\b"), (3, "f/b.csv"), (4, "c.csv"), (5, "zz")],
                                  "link_id long, name string")
    got = {r.link_id: r.table_id for r in resolve_names(names, tables).collect()}
    assert got == {0: "a", 1: "a", 2: "f/b", 3: "f/b", 4: "c.csv"}


def test_folder_and_leaf(spark):
    from lakejoin.functions.catalog import folder_of, leaf_of, strip_csv
    df = spark.createDataFrame([("a\\b/c.csv",), ("c",)], "n string")
    got = [tuple(r) for r in df.select(folder_of(F.col("n")), leaf_of(F.col("n")), strip_csv(F.col("n"))).collect()]
    assert got == [("a/b", "c.csv", "a\\b/c"), (None, "c", "c")]


def test_declared_keys_keep_order_and_repeats(spark, tmp_path):
    import json
    from lakejoin.operators.catalog import key_columns_b, merge_lakes
    from lakejoin.operators.encode import key_rows
    from lakejoin.sources.json_tables import read_table_documents
    tables = [{"table_id": "a", "columns": ["x", "y", "z"], "join_key_indices": [2, 0, 9, 2], "cells": [["1", "2", "3"]]},
              {"table_id": "b", "columns": ["x", "y"], "join_key_indices": [7, -1], "cells": [["4", "5"]]},
              {"table_id": "c", "columns": ["x"], "cells": [["6"]]}]
    (tmp_path / "t.json").write_text(json.dumps(tables))
    lake = read_table_documents(spark, str(tmp_path / "t.json"))
    got = sorted((r.table_id, r.key_pos, r.col_name) for r in key_columns_b(lake).collect())
    want = [("a", 0, "z"), ("a", 1, "x"), ("a", 2, "z"), ("b", 0, "x"), ("b", 1, "y"), ("c", 0, "x")]
    assert got == want
    assert [r.value for r in key_rows(lake).where("table_id = 'a'").orderBy("key_pos").collect()] == ["3", "1", "3"]
    over = sorted((r.table_id, r.key_pos, r.col_name) for r in key_columns_b(lake, [1, 0, 1, 5]).collect())
    assert over == [("a", 0, "y"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 0, "x")]
    assert sorted((r.table_id, r.key_pos, r.col_name) for r in key_columns_b(merge_lakes(lake, lake)).collect()) == want


def test_validity_counts_and_key_index_lists(spark):
    import pytest
    from lakejoin.functions.text import parse_key_indices
    from lakejoin.operators.catalog import validity_counts
    v = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "table_id string, valid boolean")
    assert [tuple(r) for r in validity_counts(v).collect()] == [(2, 1)]
    assert [tuple(r) for r in validity_counts(v.limit(0)).collect()] == [(0, 0)]
    df = spark.createDataFrame([(0, " 2, 0,2"), (1, " "), (2, None), (3, "-1")], "i int, t string")
    assert [r.k for r in df.select("i", parse_key_indices(F.col("t")).alias("k")).orderBy("i").collect()] == [[2, 0, 2], None, None, [-1]]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(parse_key_indices(F.lit("1,,2"))).collect()


def test_values_of_key_columns_are_not_dealt_by_column(spark):
    """One column may hold most cells: the key columns go to the cells; long values, NULL and repeated keys count as before."""
    import lakejoin.plans.registry  # noqa: F401  (imports the query modules in order)
    from lakejoin.plans.queries_catalog import _with_values
    long = "x" * 300
    cells = spark.createDataFrame([("t", i, 0, "a", v) for i, v in enumerate([long + "1", long + "2", long + "1", None, "y", ""])]
                                  + [("t", 0, 1, "b", "z"), ("u", 0, 0, "a", None)],
                                  "table_id string, row_idx long, col_idx int, col_name string, value string")
    keys = spark.createDataFrame([("t", 0, 0, "a"), ("t", 1, 0, "a"), ("u", 0, 0, "a"), ("v", 0, 0, "a")],
                                 "table_id string, key_pos int, col_idx int, col_name string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = _with_values(keys, Lake(None, None, cells))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [("t", 0, 0, "a", 4), ("t", 1, 0, "a", 4), ("u", 0, 0, "a", 0)]
    assert "Join LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
