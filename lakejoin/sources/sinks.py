"""Sinks (K1-K5): report relations and their JSON / parquet writers.

Reports are built as DataFrames (one row per query or per link); nested
arrays per query are bounded by K.  Writers use Spark's own JSON / parquet
sinks, one part file per task.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prediction_report(preds: DataFrame, run_queries: DataFrame, per_query: DataFrame | None, k: int) -> DataFrame:
    """K1 rows: query_table_id, k, metrics (NULL without truth), candidates in rank order."""
    cands = (preds.where(F.col("rank") <= k).groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("c"))
             .select("query_id", F.transform("c", lambda x: x["cand_id"]).alias("candidates")))
    rows = run_queries.select("query_id").distinct().join(cands, "query_id", "left")
    if per_query is not None:
        m = per_query.select("query_id", F.struct("p_at_k", "r_at_k", "ap_at_k", "gold_size", "hits").alias("metrics"))
        rows = rows.join(m, "query_id", "left")
    else:
        rows = rows.withColumn("metrics", F.lit(None))
    return rows.select(F.col("query_id").alias("query_table_id"), F.lit(k).alias("k"), "metrics",
                       F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def link_report(links: DataFrame) -> DataFrame:
    """K2 rows: table1, table2, column1, column2, prob."""
    return links.select("table1", "table2", "column1", "column2", "prob")


def result_map(ranking: DataFrame) -> DataFrame:
    """K3 rows: query_id -> ranked (cand_id, score) list."""
    return (ranking.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "score"))).alias("r"))
            .select("query_id", F.transform("r", lambda x: F.struct(x["cand_id"].alias("cand_id"),
                                                                     x["score"].alias("score"))).alias("results")))


def result_parts(ranking: DataFrame, k: int) -> DataFrame:
    """K3 rows with bounded arrays: (query_id, from_rank, results), ``k`` ranks a
    row, so a ranking of any length is never one array."""
    part = F.floor((F.col("rank") - 1) / k)
    return (ranking.groupBy("query_id", (part * k + 1).cast("long").alias("from_rank"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "score"))).alias("r"))
            .select("query_id", "from_rank", F.transform("r", lambda x: F.struct(x["cand_id"].alias("cand_id"), x["score"].alias("score"))).alias("results")))


RESULT_PARTS = ("results", "per_query_metrics", "avg_metrics")


def write_result(ranking: DataFrame, per_query: DataFrame, average: DataFrame, path: str, k: int) -> int:
    """K3: the whole result -- rankings in parts of ``k`` ranks, metrics per query
    and on average -- as one version.  The three relations go to a new folder and
    the manifest names it last, so a reader sees all three of one run or those of
    the run before.  Returns the version."""
    spark = ranking.sparkSession
    last = _result_version(spark, path)
    n = 1 if last is None else last[0] + 1
    folder = f"{n:06d}-{uuid.uuid4().hex}"
    for name, df in zip(RESULT_PARTS, (result_parts(ranking, k), per_query, average)):
        df.write.parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.parquet(f"{path}/manifest/version={n}")
    return n


def _result_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema("folder string, version int").parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (row["version"], row["folder"])


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of the last complete version, by name."""
    last = _result_version(spark, path)
    if last is None:
        raise FileNotFoundError(f"no complete result in {path}")
    return {name: spark.read.parquet(f"{path}/{last[1]}/{name}") for name in RESULT_PARTS}


def top_rows(ranking: DataFrame, k: int) -> DataFrame:
    """K5: the first k rows of every ranking."""
    return ranking.where(F.col("rank") <= k)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
