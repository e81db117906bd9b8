"""Line deduplication over overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines of a text is hashed.  A window whose hash
occurs again is kept where it stands first (smallest document id, then
position); the lines of later occurrences are removed, overlapping later
windows merged.  Windows of one text that overlap their own first occurrence
(a line repeated four times and more) only remove what lies beyond it.

Removed lines are held as spans, so a text of many lines takes time in
proportion.  The windows are narrow rows, pre-aggregated per hash before the shuffle.  Only
documents that lose a line meet the removal lists in a shuffle; a bitmap of
fixed size keeps all others where they are.

Edge cases: texts of fewer than three lines and windows of blank lines only
are left alone; null texts stay null; a text all of whose lines go is empty,
its row stays; null ids come first in the order; repeated rows (same id and
text) are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.llm import shared

SPAN = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    key = shared.fresh(docs.columns, "row_key")
    return docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col))), key


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, drop): the spans (a, z) of lines that go, ascending and apart, per document."""
    df, key = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    windows = df.select("id", F.col(key).alias("row_key"), F.split("text", "\n", -1).alias("l")) \
        .filter(F.size("l") >= SPAN) \
        .select("id", "row_key", F.posexplode(F.expr(
            "transform(sequence(1, size(l) - 2), i -> named_struct("
            "'h', xxhash64(l[i - 1], l[i], l[i + 1]), 'g', hash(l[i - 1], l[i], l[i + 1]), "
            "'blank', trim(concat(l[i - 1], l[i], l[i + 1])) = ''))")).alias("pos", "w")) \
        .filter(~F.col("w.blank")) \
        .select(F.col("w.h").alias("h"), F.col("w.g").alias("g"), "id", "row_key", "pos")
    first = (windows.groupBy("h", "g").agg(F.min(F.struct("id", "row_key", "pos")).alias("f"),
                                           F.count("*").alias("n"))
             .filter("n > 1").select("h", "g", "f"))
    later = windows.join(first, ["h", "g"]).filter(F.struct("id", "row_key", "pos") > F.col("f"))
    start = F.when(F.col("row_key") == F.col("f.row_key"), F.greatest("pos", F.col("f.pos") + SPAN)).otherwise(F.col("pos"))
    spans = (later.select("row_key", start.alias("a"), (F.col("pos") + SPAN - 1).alias("z"))
             .filter("a <= z").groupBy("row_key", "a").agg(F.max("z").alias("z")))
    # spans that touch become one: a new one starts where nothing before reaches to
    before = Window.partitionBy("row_key").orderBy("a")
    reach = F.max("z").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (spans.groupBy("row_key", "run").agg(F.min("a").alias("a"), F.max("z").alias("z"))
            .groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("drop")))


def _kept(text: Column, drop: Column) -> Column:
    """``text`` without the lines of the spans ``drop``: the pieces between them, in
    time that grows with the lines plus the spans."""
    def cut(x: Column) -> Column:
        begin = lambda j: F.when(j == 0, 0).otherwise(F.get(x["drop"], j - 1)["z"] + 1)
        end = lambda j: F.coalesce(F.get(x["drop"], j)["a"], F.size(x["l"]))
        pieces = F.transform(F.sequence(F.lit(0), F.size(x["drop"])), lambda j: F.slice(x["l"], begin(j) + 1, end(j) - begin(j)))
        return F.array_join(F.flatten(pieces), "\n")

    # split once, outside of the function over the spans
    return F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("l"), drop.alias("drop"))), cut)[0]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``; ``counts`` adds
    n_lines and n_removed."""
    gone = shared.staged(removals(docs, id_col, text_col))
    df, key = _keyed(docs, id_col, text_col)
    drop = shared.fresh(df.columns, "drop")
    gone = gone.select(F.col("row_key").alias(key), F.col("drop").alias(drop))
    seen, flag = shared.marked(df, gone, key)
    sure = seen.filter(~F.col(flag)).drop(flag).withColumn(drop, F.lit(None).cast(gone.schema[drop].dataType))
    hit = seen.filter(F.col(flag)).drop(flag).join(gone, key, "left")
    out = sure.unionByName(hit.select(*sure.columns))
    if counts:
        out = out.withColumns({
            shared.fresh(docs.columns, "n_lines"): F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)),
            shared.fresh(docs.columns, "n_removed"): F.when(F.col(drop).isNull(), 0).otherwise(
                F.aggregate(drop, F.lit(0), lambda n, x: n + x["z"] - x["a"] + 1))})
    kept = _kept(F.col(text_col), F.col(drop))
    return out.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)).drop(key, drop)
