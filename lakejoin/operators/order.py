"""Seeded orders and dense global indexes (W8, W9) without a single-partition
window.

``global_index`` is a DataFrame ``zipWithIndex``: range-partition + sort by
the order key, take ``monotonically_increasing_id`` (partition id in the high
bits, position in the low bits), and add per-partition offsets computed from
a tiny per-partition count.  Every task keeps its own slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.session import cut_lineage

DEFAULT_SEED = 42
SORT_ROWS = 500_000    # rows of one task of a sort whose number of rows is known


def seeded_key(seed: int, *cols: Column | str) -> Column:
    """Deterministic pseudo-random order key: md5 over the seed and ids."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def seeded_int(seed: int, modulus: int, *cols) -> Column:
    """Deterministic pseudo-random integer in [0, modulus)."""
    h = seeded_key(seed, *cols)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(modulus)).cast("int")


def global_index(df: DataFrame, order: list[Column], name: str = "idx", rows: int | None = None, keep=cut_lineage) -> DataFrame:
    """Dense 0-based index in ``order`` (a total order), distributed.  ``rows``: the
    number of rows, if known; many are dealt over more tasks than the session's
    number of partitions, so what a task reads does not grow with them.  ``keep``: how
    the sorted rows are written (``session.written`` takes less room for many)."""
    # the ids depend on physical partitioning, and a plan that counts the rows needs
    # fewer columns, so it may be partitioned otherwise: materialise the sorted rows
    # first (reliable checkpoint in the shared folder), then count what is there
    parts = -(-(rows or 0) // SORT_ROWS)
    many = parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if many else df.orderBy(*order)
    s = keep(placed.withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: tiny by construction
    return (s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_pos")).drop("_mid", "_pid", "_pos", "_off"))


def batches(df: DataFrame, batch_size: int, order: list[Column], drop_last: bool = False,
            name: str = "batch_id") -> DataFrame:
    """Fixed-size batches in ``order``; ``drop_last`` removes a short tail."""
    idx = global_index(df, order, "_bidx")
    out = idx.withColumn(name, F.floor(F.col("_bidx") / batch_size).cast("long")) \
        .withColumn("pos_in_batch", (F.col("_bidx") % batch_size).cast("int"))
    if drop_last:
        n = df.count()  # one scalar
        out = out.where(F.col("_bidx") < (n // batch_size) * batch_size)
    return out.drop("_bidx")
