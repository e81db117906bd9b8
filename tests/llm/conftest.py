import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), HERE]

from llm_data import DATA, DOC  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture()
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, None, None, None, None),
            (None, "x y z", "en", "s", 3), (3, "", "en", "s", 0), (4, long, "de", "s", 5), (5, long, "de", "s", 5),
            (6, " \n\t ", None, "s", 4), (7, "only", "fr", None, 4)]
    df = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F
    for c in ("rid", "text_key", "shard", "slot", "drop", "pii", "ids", "score", "host", "q", "hash_range", "bm_word", "rejected"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOC)
