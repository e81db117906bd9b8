"""Lakes derived from the driver's parquet tables (one scan per table).

* star lake   - all tables with all columns but the vectors, one lake table per
                parquet table, declared key links as ground truth.
* events lake - one small table per ``user_id`` (columns event_type, props).
* conv lake   - one small table per ``conv_id`` (columns role, text).
* vector lake - one table per embedding ``label``, rows are vectors.

Wide tables enter the long cell relation through one ``inline`` generator per
table (no per-column re-scan), so the parquet reader prunes to the used
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakejoin.lake import Lake, tables_from_parts
from lakejoin.session import cut_lineage

# Fixed lake layout: table -> (row id expression, used columns, key columns).
STAR_SPEC: list[tuple[str, str, list[str], list[str]]] = [
    ("region", "r_regionkey", ["r_regionkey", "r_name"], ["r_regionkey"]),
    ("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey", "n_regionkey"]),
    ("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_custkey", "c_nationkey"]),
    ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_suppkey", "s_nationkey"]),
    ("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_partkey"]),
    ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderkey", "o_custkey"]),
    ("lineitem", "hash:l_orderkey,l_linenumber,l_partkey,l_suppkey,l_returnflag,l_linestatus",
     ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
      "l_returnflag", "l_linestatus", "l_shipdate"],
     ["l_orderkey", "l_partkey", "l_suppkey"]),
    ("documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"], ["doc_id"]),
    ("labels", "doc_id", ["doc_id", "quality", "toxic"], ["doc_id"]),
    ("events", "event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_id", "user_id"]),
    ("conversations", "hash:conv_id,turn", ["conv_id", "turn", "role", "text"], ["conv_id"]),
    ("embeddings", "vec_id", ["vec_id", "label"], ["vec_id"]),
    ("pages", "page_id", ["page_id", "url", "html"], ["page_id"]),
    ("benchmark", "item_id", ["item_id", "text"], ["item_id"]),
]

# Columns of the star lake that are numbers with a fraction: their cells are printed
# with six decimals, so that every engine prints the same text.
FRACTIONS = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}

# Fixed candidate key links of the star lake: (table1, column1, table2, column2).  A link
# counts only where the data bear it out, see :func:`star_links`.
STAR_LINKS: list[tuple[str, str, str, str]] = [
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def _row_cols(row_expr: str) -> list[str]:
    if row_expr.startswith("hash:"):
        return row_expr[5:].split(",")
    import re
    return [t for t in re.findall(r"[a-z_]+", row_expr)]


def row_id_sql(row_expr: str) -> str:
    """Row-id expression: a key expression, or ``hash:c1,c2,..`` for tables
    without a unique key (60 bits of md5 over the used columns)."""
    if row_expr.startswith("hash:"):
        cols = row_expr[5:].split(",")
        body = ", ".join(f"cast({c} as string)" for c in cols)
        return f"conv(substr(md5(concat_ws('|', {body})), 1, 15), 16, 10)"
    return row_expr


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than task slots (a small file with one row
    group) is spread round-robin before the cell explosion; large inputs
    already have one split per row group and are left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _text(df: DataFrame, c: str):
    fraction = c in FRACTIONS and df.schema[c].dataType.simpleString() in ("double", "float")
    return (F.col(c).try_cast("decimal(38,6)") if fraction else F.col(c)).cast("string")


def _unpivot(df: DataFrame, table_id, row_expr: str, cols: list[str]) -> DataFrame:
    """Wide -> long cells with one generator (one scan, pruned columns)."""
    structs = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"),
                        _text(df, c).alias("value")) for i, c in enumerate(cols)]
    tid = F.lit(table_id) if isinstance(table_id, str) else table_id
    # ids first (once per input row), then the generator
    base = df.select(tid.alias("table_id"), F.expr(row_id_sql(row_expr)).cast("long").alias("row_idx"), *cols)
    return base.select("table_id", "row_idx", F.inline(F.array(*structs)))


def star_lake(spark: SparkSession, sf_dir: str) -> Lake:
    cells = None
    col_rows, pos_rows = [], []
    for pos, (name, row_expr, cols, keys) in enumerate(STAR_SPEC):
        src = read(spark, sf_dir, name).select(*sorted(set(cols) | set(_row_cols(row_expr))))
        part = _unpivot(spread(src), name, row_expr, cols)
        cells = part if cells is None else cells.unionByName(part)
        pos_rows.append((name, pos))
        for i, c in enumerate(cols):
            col_rows.append((name, i, c, None, keys.index(c) if c in keys else None))
    columns = spark.createDataFrame(col_rows, "table_id string, col_idx int, col_name string, "
                                              "description string, key_pos int")
    positions = spark.createDataFrame(pos_rows, "table_id string, table_pos long")
    return Lake(tables_from_parts(columns, cells, positions), columns, cells)


def star_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-level truth from the links that hold in the data, both directions:
    (query_id, cand_id, pos).  Tables without links are present with no
    candidates through :func:`star_truth_queries`."""
    both = star_links(spark, sf_dir).select(F.inline(F.array(
        F.struct(F.col("table1").alias("query_id"), F.col("table2").alias("cand_id")),
        F.struct(F.col("table2").alias("query_id"), F.col("table1").alias("cand_id"))))).distinct()
    w = Window.partitionBy("query_id").orderBy("cand_id")
    return both.select("query_id", "cand_id", (F.row_number().over(w) - 1).alias("pos"))


def star_truth_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n, *_ in STAR_SPEC], "query_id string")


def star_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_pos, table1, column1, table2, column2) of the candidate links that
    hold: ``column1`` has values and each of them occurs in ``column2``."""
    out = None
    for pos, (t1, c1, t2, c2) in enumerate(STAR_LINKS):
        left = read(spark, sf_dir, t1).select(F.col(c1).alias("v")).where("v IS NOT NULL").distinct()
        right = read(spark, sf_dir, t2).select(F.col(c2).alias("v")).where("v IS NOT NULL").distinct() \
            .withColumn("found", F.lit(1))
        held = (left.join(right, "v", "left").agg(F.count("v").alias("n"), F.count("found").alias("m"))
                .where("n > 0 AND n = m")
                .select(F.lit(pos).alias("link_pos"), F.lit(t1).alias("table1"), F.lit(c1).alias("column1"),
                        F.lit(t2).alias("table2"), F.lit(c2).alias("column2")))
        out = held if out is None else out.unionByName(held)
    return cut_lineage(out)   # one row per link, read several times


# Fixed column descriptions of the small-table lakes (the parquet files carry none).
DESCRIPTIONS = {
    "event_type": "Kind of user event",
    "props": "Event properties as JSON",
    "role": "Speaker of the turn",
    "text": "Message text of the turn",
}


def _grouped_lake(spark: SparkSession, df: DataFrame, prefix: str, group_col: str,
                  row_col: str, cols: list[str], keys: list[int]) -> Lake:
    """Many small tables, one per value of ``group_col``."""
    tid = F.concat(F.lit(prefix), F.col(group_col).cast("string"))
    cells = _unpivot(df, tid, row_col, cols)
    ids = df.select(tid.alias("table_id"), F.col(group_col).cast("long").alias("table_pos")).distinct()
    spec = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"),
                     F.lit(DESCRIPTIONS.get(c)).cast("string").alias("description"),
                     F.lit(keys.index(i) if i in keys else None).cast("int").alias("key_pos"))
            for i, c in enumerate(cols)]
    # the column catalog is (#tables x #cols): a fixed generator per table id
    columns = ids.select("table_id", F.inline(F.array(*spec)))
    return Lake(tables_from_parts(columns, cells, ids), columns, cells)


def events_lake(spark: SparkSession, sf_dir: str) -> Lake:
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return _grouped_lake(spark, df, "user-", "user_id", "event_id", ["event_type", "props"], [0, 1])


def conversations_lake(spark: SparkSession, sf_dir: str) -> Lake:
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return _grouped_lake(spark, df, "conv_", "conv_id", "turn", ["role", "text"], [0, 1])


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector lake rows: (table_id, table_pos, row_idx, vec array<double>)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("table_id"),
                    F.col("label").cast("long").alias("table_pos"),
                    F.col("vec_id").cast("long").alias("row_idx"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
