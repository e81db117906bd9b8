"""JSON table documents and ground-truth files.

A file holds one JSON document (an array of table objects, or an object
``{"tables": [...]}``).  Table files are read in splits, several tasks a file
(:mod:`lakejoin.sources.split_json`); each object is parsed on its own and
exploded into the long cell relation.  Convert once to parquet for repeated use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakejoin.lake import Lake, tables_from_parts
from lakejoin.operators.order import global_index
from lakejoin.sources.split_json import elements

TABLE_STRUCT = ("struct<table_id:string, columns:array<string>, cells:array<array<string>>, "
                "rows:array<array<string>>, descriptions:array<string>, join_key_indices:array<int>, "
                "base_id:string, partition:string, ground_truth:array<string>>")


def _docs(spark: SparkSession, path: str) -> DataFrame:
    """(file, table_pos, doc) for every table object of every file, in file
    order; a wrapper object, an array, or a single object are all accepted."""
    one = F.from_json("value", TABLE_STRUCT)
    bad = F.raise_error(F.concat(F.lit("unreadable table document "), F.col("file"), F.lit(": a table without table_id or no readable JSON")))
    docs = elements(spark, path).select("file", "block", "n", one.alias("doc"))
    docs = docs.withColumn("doc", F.when(F.col("doc").isNull() | F.col("doc.table_id").isNull(), bad).otherwise(F.col("doc")))
    return docs.select("file", F.struct("file", "block", "n").alias("table_pos"), "doc")


def _numbered(docs: DataFrame) -> DataFrame:
    """Positions of ``(file, block, n)`` as numbers: only ids are put in order."""
    if dict(docs.dtypes)["table_pos"] == "bigint":
        return docs
    order = global_index(docs.select("table_pos"), [F.col("table_pos")], "pos")
    return docs.join(order, "table_pos").withColumn("table_pos", F.col("pos").cast("long")).drop("pos")


def _tables_of(value):
    """(tables, reason): the table objects of a JSON text, and why it has none."""
    arr = F.from_json(value, f"array<{TABLE_STRUCT}>")
    wrapped = F.from_json(value, f"struct<tables:array<{TABLE_STRUCT}>>")["tables"]
    single = F.array(F.from_json(value, TABLE_STRUCT))
    tables = (F.when(value.startswith("["), arr)
              .when(wrapped.isNotNull(), wrapped)
              .otherwise(single))
    no_id = F.exists(tables, lambda t: t.isNull() | t["table_id"].isNull())
    reason = (F.when(tables.isNull(), F.lit("no readable JSON"))
              .when(no_id, F.lit("a table without table_id")))
    return tables, reason


def json_rejects(raw: DataFrame) -> DataFrame:
    """(file, reason) of the documents of ``raw(file, value)`` that cannot be read as tables."""
    _, reason = _tables_of(F.trim("value"))
    return raw.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())


def documents_from_text(raw: DataFrame, on_error: str = "raise") -> DataFrame:
    """``raw(file, value)`` (one JSON document per row) -> (file, table_pos, doc).
    A document that cannot be read fails the job; with ``on_error="skip"`` it
    is left to :func:`json_rejects`."""
    raw = raw.select("file", F.trim("value").alias("value"))
    tables, reason = _tables_of(F.col("value"))
    if on_error == "skip":
        raw = raw.where(reason.isNull())
    else:
        tables = F.when(reason.isNotNull(), F.raise_error(F.concat(
            F.lit("unreadable table document "), F.col("file"), F.lit(": "), reason))).otherwise(tables)
    docs = raw.select("file", F.posexplode(tables).alias("pos_in_file", "doc"))
    # file order then position; only the (small) list of file names is ranked,
    # the documents themselves never leave their scan task for this
    files = docs.select("file").distinct()
    files = files.withColumn("file_rank", F.row_number().over(Window.orderBy("file")) - 1)
    return (docs.join(files, "file")
            .withColumn("table_pos", F.col("file_rank") * F.lit(1 << 32) + F.col("pos_in_file"))
            .drop("file_rank"))


def _dedupe(docs: DataFrame, mode: str) -> DataFrame:
    if mode == "none":
        return docs
    order = F.desc("table_pos") if mode == "last" else F.asc("table_pos")
    w = Window.partitionBy(F.col("doc.table_id")).orderBy(order)
    return docs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_table_documents(spark: SparkSession, path: str, layout: str = "row_major",
                         dedupe: str = "last", pad_short_rows: bool = True) -> Lake:
    return lake_from_documents(_docs(spark, path), layout, dedupe, pad_short_rows)


def lake_from_documents(docs: DataFrame, layout: str = "row_major", dedupe: str = "last",
                        pad_short_rows: bool = True) -> Lake:
    """S1/S2/S3/S11 -> Lake.

    layout ``row_major``: ``cells[r][c]``, short rows padded with NULL (S1);
    ``column_major``: ``cells[c][r]``; ``rows``: ``rows[r][c]`` with short
    rows compacting the column (values re-indexed per column, S11).
    dedupe: ``last`` (S1), ``first`` (C14, B) or ``none`` (S2 list).
    pad_short_rows: row-major rows shorter than the header get NULL cells
    (A's loader, also for empty rows); off, only present cells are emitted
    (B keeps raw rows: empty rows vanish, short rows are padded later)."""
    docs = _numbered(_dedupe(docs, dedupe))
    d = docs.select("table_pos", F.col("doc.*"))
    listed = F.filter(F.coalesce("join_key_indices", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("columns")))
    keys = d.select("table_id", F.posexplode(listed).alias("key_pos", "col_idx"))
    columns = d.select("table_id", F.posexplode("columns").alias("col_idx", "col_name"),
                       F.col("descriptions"), F.array_distinct(listed).alias("keys"))
    columns = columns.select(
        "table_id", "col_idx", "col_name",
        F.try_element_at(F.coalesce("descriptions", F.array().cast("array<string>")), (F.col("col_idx") + 1).cast("int")).alias("description"),
        # position among the listed indices that exist; a repeated index counts once here, and each time in ``keys``
        F.when(F.array_position("keys", F.col("col_idx")) > 0, F.array_position("keys", F.col("col_idx")) - 1)
        .cast("int").alias("key_pos"))
    ncol = F.size("columns")
    if layout == "row_major":
        rows = d.select("table_id", "columns", F.posexplode(F.coalesce("cells", F.array())).alias("row_idx", "row"))
        if pad_short_rows:
            cells = rows.select("table_id", F.col("row_idx").cast("long"), F.posexplode("columns").alias("col_idx", "col_name"),
                                "row").select("table_id", "row_idx", "col_idx", "col_name",
                                              F.try_element_at("row", (F.col("col_idx") + 1).cast("int")).alias("value"))
        else:
            cells = (rows.select("table_id", F.col("row_idx").cast("long"), "columns",
                                 F.posexplode("row").alias("col_idx", "value"))
                     .where(F.col("col_idx") < F.size("columns"))
                     .select("table_id", "row_idx", "col_idx",
                             F.try_element_at("columns", (F.col("col_idx") + 1).cast("int")).alias("col_name"), "value"))
    elif layout == "column_major":
        colv = d.select("table_id", "columns", F.posexplode(F.coalesce("cells", F.array())).alias("col_idx", "vals"))
        cells = (colv.where(F.col("col_idx") < F.size("columns"))
                 .select("table_id", "col_idx", F.try_element_at("columns", (F.col("col_idx") + 1).cast("int")).alias("col_name"),
                         F.posexplode("vals").alias("row_idx", "value"))
                 .select("table_id", F.col("row_idx").cast("long"), "col_idx", "col_name", "value"))
    elif layout == "rows":
        rows = d.select("table_id", "columns", F.posexplode(F.coalesce("rows", F.array())).alias("src_row", "row"))
        raw = rows.select("table_id", "src_row", F.posexplode("row").alias("col_idx", "value"), "columns") \
            .where(F.col("col_idx") < F.size("columns"))
        w = Window.partitionBy("table_id", "col_idx").orderBy("src_row")
        cells = raw.select("table_id", (F.row_number().over(w) - 1).cast("long").alias("row_idx"), "col_idx",
                           F.try_element_at("columns", (F.col("col_idx") + 1).cast("int")).alias("col_name"), "value")
    else:
        raise ValueError(f"unknown layout {layout}")
    positions = d.select("table_id", "table_pos", "base_id", "partition")
    return Lake(tables_from_parts(columns, cells, positions), columns, cells, keys)


def ragged_to_rows(lake: Lake, col_indices: list[int]) -> DataFrame:
    """Rows over the chosen columns of a column-major lake; ragged
    columns padded with '' up to the longest chosen column.
    Output (table_id, row_idx, pos, value)."""
    chosen = F.array(*[F.lit(int(i)) for i in col_indices])
    sel = lake.columns.select("table_id", F.posexplode(chosen).alias("pos", "col_idx")).distinct()
    sel = sel.join(lake.columns.select("table_id", "col_idx"), ["table_id", "col_idx"], "left")
    lens = (lake.cells.join(sel.select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi")
            .groupBy("table_id").agg(F.max("row_idx").alias("max_row")))
    grid = (sel.join(lens, "table_id")
            .select("table_id", "pos", "col_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_row"))).alias("row_idx")))
    return (grid.join(lake.cells.select("table_id", "col_idx", "row_idx", "value"), ["table_id", "col_idx", "row_idx"], "left")
            .select("table_id", "row_idx", "pos", F.coalesce("value", F.lit("")).alias("value")))


def _or_fail(parsed):
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("unreadable truth file "), F.col("file")))).otherwise(parsed)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth as ``truth(query_id, cand_id, pos)`` plus
    ``truth_queries(query_id)`` (entries with an empty list included).

    Accepts ``{query: [cands]}`` (non-list values skipped, empty ids skipped)
    or ``[{"query_id", "positives"}]`` (last entry of an id wins)."""
    raw = (spark.read.option("wholetext", True).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")))
    # map form: parse values as raw JSON text first so one bad entry cannot null the map
    m = raw.where(~F.col("value").startswith("[")).select(
        "file", F.explode(_or_fail(F.from_json("value", "map<string,string>"))).alias("query_id", "v"))
    m = m.select("file", F.lit(0).alias("entry"), "query_id", F.from_json("v", "array<string>").alias("cands")) \
        .where(F.col("cands").isNotNull() & F.trim("v").startswith("["))
    lst = raw.where(F.col("value").startswith("[")).select(
        "file", F.posexplode(_or_fail(F.from_json("value", "array<struct<query_id:string, positives:array<string>>>")))
        .alias("entry", "e"))
    lst = lst.select("file", "entry", F.col("e.query_id").alias("query_id"), F.col("e.positives").alias("cands")) \
        .where(F.col("cands").isNotNull())
    both = m.unionByName(lst).where(F.col("query_id").isNotNull() & (F.col("query_id") != ""))
    w = Window.partitionBy("query_id").orderBy(F.desc("file"), F.desc("entry"))
    last = both.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    truth = last.select("query_id", F.posexplode("cands").alias("pos", "cand_id")).select("query_id", "cand_id", "pos")
    return truth, last.select("query_id")


def inline_truth(spark: SparkSession, path: str, file_truth: DataFrame, file_queries: DataFrame):
    """A table's own ``ground_truth`` is used only when the file has no
    entry for that id."""
    docs = _docs(spark, path).select(F.col("doc.table_id").alias("query_id"), F.col("doc.ground_truth").alias("gt"))
    inl = docs.where(F.col("gt").isNotNull()).join(file_queries, "query_id", "left_anti")
    extra = inl.select("query_id", F.posexplode("gt").alias("pos", "cand_id")).select("query_id", "cand_id", "pos")
    return file_truth.unionByName(extra), file_queries.unionByName(inl.select("query_id")).distinct()


def write_table_documents(lake: Lake, path: str, n_files: int | None = None) -> None:
    """Sink: the lake as row-major table documents, one JSON array file a
    partition (or ``n_files``), one table a line."""
    cells = lake.cells
    rows = (cells.groupBy("table_id", "row_idx")
            .agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("r"))
            .select("table_id", "row_idx", F.transform("r", lambda x: x["value"]).alias("row")))
    cols = (lake.columns.groupBy("table_id")
            .agg(F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "key_pos"))).alias("c")))
    docs = (rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "row"))).alias("rs"))
            .join(cols, "table_id")
            .select("table_id", F.to_json(F.struct(
                F.col("table_id"),
                F.transform("c", lambda x: x["col_name"]).alias("columns"),
                F.transform("rs", lambda x: x["row"]).alias("cells"),
                F.transform(F.filter(F.array_sort(F.transform("c", lambda x: F.struct(x["key_pos"].alias("k"), x["col_idx"].alias("i")))),
                                     lambda x: x["k"].isNotNull()), lambda x: x["i"]).alias("join_key_indices"))).alias("doc")))
    write_array(docs.select("doc"), path, n_files)


def write_array(docs: DataFrame, path: str, n_files: int | None = None, wrapped: bool = False) -> None:
    """One JSON array a partition, one object a line: rows are written as they
    come, whatever their number.  ``wrapped``: ``{"tables": [...]}``."""
    head, tail = ('{"tables": [', "]}") if wrapped else ("[", "]")

    def lines(batches):
        import pyarrow as pa
        before = head
        for batch in batches:
            for at in range(0, batch.num_rows, 256):          # a batch can hold many long documents
                rows = batch.column(0).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([before + rows[0], *["," + r for r in rows[1:]]], pa.string())], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array([(head if before == head else "") + tail], pa.string())], names=["value"])

    docs = docs.repartition(n_files) if n_files else docs
    docs.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_truth(truth: DataFrame, truth_queries: DataFrame, path: str) -> None:
    """Sink: truth as one ``{query: [cands]}`` JSON object per file."""
    lists = (truth_queries.join(truth, "query_id", "left").groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "cand_id"))).alias("l"))
             .select("query_id", F.transform(F.filter("l", lambda x: x["cand_id"].isNotNull()), lambda x: x["cand_id"]).alias("c")))
    obj = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("query_id", "c")))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)
