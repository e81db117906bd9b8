from pyspark.sql import functions as F

from lakejoin.lake import Lake, tables_from_parts
from lakejoin.operators import profile as P


def small_lake(spark, rows):
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    cols = cells.select("table_id", "col_idx", "col_name").distinct().select(
        "*", F.lit(None).cast("string").alias("description"), F.lit(None).cast("int").alias("key_pos"))
    pos = cells.select("table_id").distinct().withColumn("table_pos", F.lit(0))
    return Lake(tables_from_parts(cols, cells, pos), cols, cells)


def test_profile_counts_null_once(spark):
    lake = small_lake(spark, [("t", 0, 0, "c", "aa"), ("t", 1, 0, "c", None), ("t", 2, 0, "c", None), ("t", 3, 0, "c", "b")])
    p = P.column_profile(P.value_groups(lake.cells)).first()
    assert (p.n_distinct, p.max_len, p.min_len, p.avg_len) == (3, 2, 1, 1.5)
    text = P.column_text(lake, "colname-stat-col").first().text
    assert text == "c contains 3 values (2, 1, 1.5): aa, b"


def test_stable_rank_and_budget_prefix(spark):
    rows = [("t", i, 0, "c", v) for i, v in enumerate(["b", "a", "a", "c", "b", "d e f"])]
    lake = small_lake(spark, rows)
    ranked = P.rank_values(P.value_frequency(lake.cells))
    order = [r.value for r in ranked.orderBy("rn").collect()]
    assert order == ["b", "a", "c", "d e f"]  # ties keep first appearance
    # budget 5: b(1) a(1+1) c(1+1) -> 5; "d e f" would cost 4 more
    s = [r.value for r in P.sample_values(ranked, budget=5).orderBy("rn").collect()]
    assert s == ["b", "a", "c"]
    s = [r.value for r in P.sample_values(ranked, budget=4).orderBy("rn").collect()]
    assert s == ["b", "a"]


def test_first_value_over_budget_kept_alone(spark):
    long = " ".join(["w"] * 50)
    lake = small_lake(spark, [("t", 0, 0, "c", long), ("t", 1, 0, "c", long), ("t", 2, 0, "c", "x")])
    ranked = P.rank_values(P.value_frequency(lake.cells))
    s = P.sample_values(ranked, budget=10).collect()
    assert [r.value for r in s] == [long[:20]]


def test_lake_frequency_ranking(spark):
    rows = [("t", 0, 0, "c", "x"), ("t", 1, 0, "c", "y"), ("t", 2, 0, "c", "y")]
    lake = small_lake(spark, rows)
    lf = spark.createDataFrame([("x", 10)], "value string, freq long")
    order = [r.value for r in P.rank_values(P.value_frequency(lake.cells), lf).orderBy("rn").collect()]
    assert order == ["x", "y"]


def test_long_values_move_as_short_keys(spark):
    """Values that differ beyond the cut stay apart, and a group's row does not grow with its value."""
    from pyspark.sql import functions as F
    from lakejoin.operators import profile as P
    long = "x" * 5000
    vals = [long + "a", long + "b", long + "a", "y", None, "z" * P.VALUE_CUT]
    cells = spark.createDataFrame([("t", i, 0, "c", v) for i, v in enumerate(vals)], "table_id string, row_idx long, col_idx int, col_name string, value string")
    short, whole = P.short_groups(cells), P.value_groups(cells)
    assert short.agg(F.max(F.length("value"))).first()[0] <= P.VALUE_CUT + 64
    assert P.column_profile(short).collect() == P.column_profile(whole).collect()
    key = lambda g: sorted((r.freq, r.first_row, (r.value or "")[:P.VALUE_CUT]) for r in g.collect())
    assert key(short) == key(whole)


def test_columns_are_joined_without_a_shuffle_by_column(spark):
    from lakejoin.operators import profile as P
    cells = spark.createDataFrame([(f"t{i % 3}", i, 0, "c", str(i)) for i in range(999)], "table_id string, row_idx long, col_idx int, col_name string, value string")
    need = spark.createDataFrame([("t1", "c"), ("t2", "other")], "table_id string, col_name string")
    out = P.by_column(cells, need, "left_semi")
    assert out.count() == 333
    assert "hashpartitioning(table_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_profile_and_ranking_read_one_exchange_of_the_values(spark):
    """Column texts group the cells once; columns of NULL only, of empty texts and with NULL row ids keep their profile."""
    rows = [("t", i, 0, "a", v) for i, v in enumerate(["x", None, "yy", "x"])] + [("t", None, 1, "b", None), ("t", 1, 2, "c", ""), ("t", 2, 2, "c", None)]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    columns = spark.createDataFrame([("t", i, c, None, None) for i, c in enumerate("abcd")],
                                    "table_id string, col_idx int, col_name string, description string, key_pos int")
    df = P.column_text(Lake(None, columns, cells), "colname-stat-col")
    got = {r.col_name: r.text for r in df.collect()}
    assert got == {"a": "a contains 3 values (2, 1, 1.3): x, yy", "b": "b contains 1 values (0, 0, 0.0): ",
                   "c": "c contains 2 values (0, 0, 0.0): ", "d": "d contains 0 values (0, 0, 0.0): "}
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_ranking_by_lake_frequency_reads_the_same_exchange(spark):
    """The ranking alone needs no frequency of its own there, and made its own groups for that."""
    rows = [("t", i, 0, "a", v) for i, v in enumerate(["x", None, "yy", "x", "z"])]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    columns = spark.createDataFrame([("t", 0, "a", None, None)], "table_id string, col_idx int, col_name string, description string, key_pos int")
    freq = spark.createDataFrame([("z", 9), ("yy", 3)], "value string, freq long")
    df = P.column_text(Lake(None, columns, cells), "colname-stat-col", freq)
    assert [r.text for r in df.collect()] == ["a contains 4 values (2, 1, 1.2): z, yy, x"]
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_long_values_are_ranked_by_short_keys(spark, monkeypatch):
    """The ranking of all values by lake frequency: long ones that share their cut stay apart and are not sorted themselves."""
    long = ["p" * 300 + str(i % 7) for i in range(12)]
    rows = [(t, i, 0, "c", v) for t in ("t", "u") for i, v in enumerate([*long, "a", None, "b", "", "a"])]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    freq = spark.createDataFrame([(long[3], 5), ("b", 7), ("a", 2)], "value string, freq long")
    sorted_, keep = [], P.written
    monkeypatch.setattr(P, "written", lambda df: sorted_.append(keep(df)) or sorted_[-1])
    key = lambda df: sorted((r.table_id, r.col_name, r.value, r.rn) for r in df.collect())
    got = key(P.rank_all_cells(cells, freq))
    assert got == key(P.rank_all_values(P.value_frequency(cells), freq)) and len(got) == 20
    assert max(len(r.value) for df in sorted_ for r in df.collect()) <= P.VALUE_CUT + 64
