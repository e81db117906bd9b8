"""Corpus pipeline: five stages, each an operator of ``lakejoin.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared checkpoint folder and read again as the next stage's
docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.llm import bpe, decontaminate, jaccard, line_dedup, shared, toxicity
from lakejoin.llm.queries import CATEGORIES, tokenizer_json


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.reject(shared.spread(docs), shared.table(spark, sf_dir, "labels"), CATEGORIES)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; every document stays, with its new length."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays."""
    return jaccard.one_of_each(shared.spread(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return decontaminate.remove_contaminated(shared.spread(docs), shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(shared.spread(docs), tokenizer_json())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", drop_near_copies),
          ("decontamination", drop_contaminated), ("bpe", encode)]

# A trained model and a tokenizer's merges cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir))
    return shared.staged(STAGES[-1][1](spark, docs, sf_dir))
