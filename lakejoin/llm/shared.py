"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejoin.session import checkpoint_dir

# A fixed-size bitmap of hashed ids: 2^24 bits, at most 2^18 rows of (word, bits).
BITMAP_BITS = 1 << 24


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage is cut, a lost executor costs nothing, and the reader knows
    the true size (so Spark's own size check decides on broadcasts)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20    # of texts that travel to Python at a time


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` within bounded memory: batches of BATCH_BYTES (a session
    that sets a size of its own keeps it), and at the end of a task the worker,
    which Spark keeps for the next one, gives its free memory back."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_CONF, "67108864b") in ("67108864b", "64m", "64MB"):     # Spark's default
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):      # another C library
            pass

    return df.mapInArrow(lean, schema)


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, or a variant of it that is not in ``taken`` (case-insensitive)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than task slots out to all slots; larger
    inputs have one split per row group and stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _bit(col: str):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(BITMAP_BITS))


def id_bitmap(ids: DataFrame, col: str, word: str, bits: str) -> DataFrame:
    """(word, bits) over the ids; at most 2^18 rows at any input size."""
    return (ids.select(_bit(col).alias("i"))
            .select(F.shiftright("i", 6).alias(word), F.expr("shiftleft(1L, cast(i & 63 as int))").alias("b"))
            .groupBy(word).agg(F.bit_or("b").alias(bits)))


def marked(df: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, str]:
    """``df`` with a flag: may the id be one of ``ids``?  The bitmap is broadcast:
    its size is bounded by BITMAP_BITS, not by the data."""
    i, word, bits, flag = (fresh(df.columns, c) for c in ("bm_i", "bm_word", "bm_bits", "bm_maybe"))
    out = (df.withColumn(i, _bit(col))
           .join(F.broadcast(id_bitmap(ids, col, word, bits)), F.shiftright(F.col(i), 6) == F.col(word), "left")
           .withColumn(flag, F.coalesce(
               F.expr(f"(shiftright(`{bits}`, cast(`{i}` & 63 as int)) & 1) = 1"), F.lit(False)))
           .drop(i, word, bits))
    return out, flag


def maybe_in(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose id may be in ``ids`` (a superset; no shuffle of ``df``)."""
    out, flag = marked(df, ids, col)
    return out.filter(F.col(flag)).drop(flag)


def without(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Exact anti-join of wide rows on one long column.  Rows that miss the
    bitmap are kept where they are; only the others meet ``ids`` in a shuffle.
    Rows with a null id are kept."""
    out, flag = marked(df, ids, col)
    sure = out.filter(~F.col(flag)).drop(flag)
    left = out.filter(F.col(flag)).drop(flag)
    return sure.unionByName(left.join(ids.select(col).distinct(), col, "left_anti").select(*df.columns))
