"""CSV table folders (S7-S9) and link files.

Each CSV file is one table with its own header, so schemas differ per file:
files are listed by Spark (``binaryFile``) and parsed with pandas inside
``mapInPandas`` on the executors -- one file per record, emitted straight
into the long cell relation.  pandas' type inference is kept on purpose
(``NA`` tokens become NULL, integer columns with gaps print as ``1.0``).
Unreadable files become ``rejects`` rows instead of failing the job.
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.functions.catalog import strip_csv
from lakejoin.functions.text import strip
from lakejoin.lake import Lake, tables_from_parts

CELL_SCHEMA = ("table_id string, row_idx long, col_idx int, col_name string, value string, "
               "error string")


def _parse(strip_names: bool):
    def run(batches):
        import io
        for pdf in batches:
            # plain lists: a data frame for each column of each small file costs more than reading it
            out = {c: [] for c in ("table_id", "row_idx", "col_idx", "col_name", "value", "error")}

            def add(*parts):
                for got, part in zip(out.values(), parts):
                    got.extend(part)

            for tid, content in zip(pdf["table_id"], pdf["content"]):
                try:
                    df = pd.read_csv(io.BytesIO(bytes(content)))
                except Exception as e:  # unreadable file -> reject row
                    add([tid], [None], [None], [None], [None], [repr(e)])
                    continue
                n = len(df)
                for i, c in enumerate(df.columns):
                    vals = [None if pd.isna(x) else str(x) for x in df.iloc[:, i].tolist()]
                    add([tid] * n, range(n), [i] * n, [str(c).strip() if strip_names else str(c)] * n, vals, [None] * n)
                if len(df.columns) and n == 0:
                    add([tid], [None], [None], [None], [None], ["__empty__"])
            if out["table_id"]:
                yield pd.DataFrame({c: pd.array(v, "Int64") if c.endswith("_idx") else pd.Series(v, dtype=object) for c, v in out.items()})
    return run


def _headers(strip_names: bool):
    def run(batches):
        import io
        for pdf in batches:
            out = []
            for tid, content in zip(pdf["table_id"], pdf["content"]):
                try:
                    cols = pd.read_csv(io.BytesIO(bytes(content)), nrows=0).columns
                except Exception:
                    continue
                out.append(pd.DataFrame({"table_id": tid, "col_idx": range(len(cols)),
                                         "col_name": [str(c).strip() if strip_names else str(c) for c in cols]}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return run


def _folder_files(spark: SparkSession, table_dir: str) -> DataFrame:
    """The files ``dir/<folder>/<table>.csv``.  Only the folders' names are listed by the
    driver, the folders by tasks; a pattern down to the files would be expanded by the
    driver, one folder after the other."""
    root, reader = table_dir.rstrip("/"), spark.read.format("binaryFile")
    if re.search(r"[*?\[{]", root):
        return reader.load(f"{root}/*/*.csv")
    files = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(f"{root}/*")
    # not the files beside the folders or deeper
    end = re.sub(r"^(\.\.?(/|$))+", "", posixpath.normpath(re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)))
    return files.filter(F.regexp_replace("path", r"/[^/]+/[^/]+$", "").endswith(end))


def read_csv_tables(spark: SparkSession, table_dir: str, layout: str = "flat") -> tuple[Lake, DataFrame]:
    """S7 (``flat``: ``dir/<table>.csv``, id = stem, names stripped) and S8
    (``folder``: ``dir/<folder>/<table>.csv``, id = ``folder/stem``, names kept).
    Returns (lake, rejects(table_id, error))."""
    files = spark.read.format("binaryFile").load(f"{table_dir.rstrip('/')}/*.csv") if layout == "flat" else _folder_files(spark, table_dir)
    if layout == "flat":
        tid = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    else:
        tid = F.concat_ws("/", F.regexp_extract("path", r"([^/]+)/[^/]+\.csv$", 1),
                          F.regexp_extract("path", r"([^/]+)\.csv$", 1))
    f = files.select(F.col("path"), tid.alias("table_id"), "content")
    strip_names = layout == "flat"
    parsed = f.select("table_id", "content").mapInPandas(_parse(strip_names), CELL_SCHEMA)
    parsed = parsed.persist()
    cells = parsed.where(F.col("error").isNull()).drop("error")
    rejects = parsed.where(F.col("error").isNotNull() & (F.col("error") != "__empty__")).select("table_id", "error")
    columns = (f.select("table_id", "content").mapInPandas(_headers(strip_names), "table_id string, col_idx int, col_name string")
               .select("table_id", "col_idx", "col_name", F.lit(None).cast("string").alias("description"),
                       F.lit(None).cast("int").alias("key_pos")))
    columns = columns.join(rejects.select("table_id"), "table_id", "left_anti")
    positions = columns.select("table_id").distinct().withColumn("table_pos", F.xxhash64("table_id"))
    return Lake(tables_from_parts(columns, cells, positions), columns, cells), rejects


def read_links(spark: SparkSession, path: str, lake: Lake) -> DataFrame:
    """Headerless ``table1, table2, column1, column2`` rows; names are
    slash-normalised, trimmed and lose '.csv'; both tables must resolve (C6)
    and both columns must exist.  Duplicates are kept."""
    from lakejoin.operators.catalog import resolve_names
    raw = (spark.read.schema("table1 string, table2 string, column1 string, column2 string")
           .option("header", False).option("mode", "DROPMALFORMED").csv(path)
           .where(F.col("table1").isNotNull() & F.col("table2").isNotNull()
                  & F.col("column1").isNotNull() & F.col("column2").isNotNull()))
    clean = raw.select(
        F.monotonically_increasing_id().alias("link_id"),
        strip_csv(strip(F.translate("table1", "\\", "/"))).alias("t1"),
        strip_csv(strip(F.translate("table2", "\\", "/"))).alias("t2"),
        strip(F.col("column1")).alias("column1"), strip(F.col("column2")).alias("column2"))
    r1 = resolve_names(clean.select("link_id", F.col("t1").alias("name")), lake.tables).withColumnRenamed("table_id", "table1")
    r2 = resolve_names(clean.select("link_id", F.col("t2").alias("name")), lake.tables).withColumnRenamed("table_id", "table2")
    cols = lake.columns.select("table_id", "col_name")
    out = (clean.join(r1.select("link_id", "table1"), "link_id").join(r2.select("link_id", "table2"), "link_id")
           .join(cols.select(F.col("table_id").alias("table1"), F.col("col_name").alias("column1")), ["table1", "column1"], "left_semi")
           .join(cols.select(F.col("table_id").alias("table2"), F.col("col_name").alias("column2")), ["table2", "column2"], "left_semi"))
    return out.select("link_id", "table1", "column1", "table2", "column2")
