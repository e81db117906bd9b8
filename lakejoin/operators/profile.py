"""Column profiles and value sampling.

Everything is keyed by (table_id, col_name).  The expensive step is the
value-frequency aggregate (one hash aggregate with map-side combine, keyed by
(table, column, value)); the profile and the frequent-value sample are
derived from it, so the cells are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejoin.functions.text import VALUE_JOIN, fmt_1f, n_words
from lakejoin.lake import Lake
from lakejoin.operators.order import global_index
from lakejoin.session import cut_lineage, written

# Sequence budget of the column text (384 positions minus 150
# reserved for title, name and statistics) and the per-value cut.
MAX_SEQ_LENGTH = 384
RESERVED_TOKENS = 150
VALUE_CUT = 200
DEFAULT_BUDGET = MAX_SEQ_LENGTH - RESERVED_TOKENS

PATTERNS = ["col", "colname-col", "colname-stat-col", "title-colname-col",
            "title-colname-stat-col", "default"]

KEY = ["table_id", "col_name"]


FEW_COLUMNS = 100_000    # rows of a relation of columns that may be broadcast


def by_column(df: DataFrame, columns: DataFrame, how: str = "inner", on: list[str] = KEY) -> DataFrame:
    """``df`` joined with a relation that has a row a column (``on``: its id).  A few columns
    can hold most of the cells, and a shuffle by column would put each into one
    task: the columns are broadcast while they are few."""
    columns = cut_lineage(columns)
    return df.join(F.broadcast(columns) if columns.count() <= FEW_COLUMNS else columns, on, how)


def short_key(value: Column) -> Column:
    """A value as it is, or, beyond VALUE_CUT characters, its first VALUE_CUT and its
    sha256: equal where the values are, with the same cut."""
    return F.when(F.length(value) <= VALUE_CUT, value).otherwise(F.concat(F.substring(value, 1, VALUE_CUT), F.sha2(value, 256)))


def short_groups(cells: DataFrame) -> DataFrame:
    """:func:`value_groups` for column texts, which print no more than a value's cut:
    ``value`` is its :func:`short_key`, so long texts are not shuffled; with ``len``."""
    return (cells.select(*KEY, short_key(F.col("value")).alias("value"), F.length("value").alias("len"), "row_idx")
            .groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("freq"), F.min("row_idx").alias("first_row"), F.max("len").alias("len")))


def value_groups(cells: DataFrame) -> DataFrame:
    """(table_id, col_name, value, freq, first_row) with NULL kept as one group."""
    return (cells.groupBy("table_id", "col_name", "value")
            .agg(F.count(F.lit(1)).alias("freq"), F.min("row_idx").alias("first_row")))


def value_frequency(cells: DataFrame) -> DataFrame:
    """A1: non-null value counts per column."""
    return value_groups(cells).where(F.col("value").isNotNull())


def column_profile(groups: DataFrame) -> DataFrame:
    """A2: distinct count (NULL counts as one value) and max / min / mean text
    length over non-null cells (0 when the column has none)."""
    ln = most = F.col("len") if "len" in groups.columns else F.length("value")
    if "len" in groups.columns:
        # NULL has no length, so 0 does for it; with ``first_row`` named, the profile needs the same columns
        # as the ranking, and both read one exchange of the groups
        most = F.when(F.col("first_row").isNull() & ln.isNull(), 0).otherwise(ln)
    return (groups.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.max(most), F.lit(0)).cast("long").alias("max_len"),
        F.coalesce(F.min(ln), F.lit(0)).cast("long").alias("min_len"),
        F.coalesce(F.sum(ln * F.col("freq")) / F.sum(F.when(F.col("value").isNotNull(), F.col("freq"))),
                   F.lit(0.0)).alias("avg_len")))


def lake_value_frequency(lake: Lake) -> DataFrame:
    """A3: lake-wide counts of non-null values of join-key columns only."""
    return (lake.key_cells().where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("freq")))


def rank_values(freq: DataFrame, lake_freq: DataFrame | None = None,
                limit: int | None = None) -> DataFrame:
    """W1 (+J9): rank distinct values per column by own frequency, or by the
    lake frequency (0 when absent), descending; ties keep first appearance.

    ``limit`` keeps ``rn <= limit``; Spark then plans a partial top-k before
    the shuffle (WindowGroupLimit), so a column with billions of distinct
    values never lands whole in one task."""
    if lake_freq is not None:
        lf = lake_freq.select("value", F.col("freq").alias("lake_freq"))
        freq = freq.join(lf, "value", "left").withColumn("order_freq", F.coalesce("lake_freq", F.lit(0)))
    else:
        freq = freq.withColumn("order_freq", F.col("freq"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("order_freq"), F.asc("first_row"))
    out = freq.withColumn("rn", F.row_number().over(w).cast("long"))
    if limit is not None:
        out = out.where(F.col("rn") <= limit)
    return out


def rank_all_values(freq: DataFrame, lake_freq: DataFrame | None = None, keep=cut_lineage) -> DataFrame:
    """W1 for the whole ranking: the same ``rn`` as :func:`rank_values` without a
    limit, by a range sort over all columns and the offset of each column, so a
    column of any number of distinct values is spread over many tasks."""
    if lake_freq is not None:
        freq = freq.join(lake_freq.select("value", F.col("freq").alias("lake_freq")), "value", "left") \
            .withColumn("order_freq", F.coalesce("lake_freq", F.lit(0)))
    else:
        freq = freq.withColumn("order_freq", F.col("freq"))
    at = global_index(freq, [*[F.col(c) for c in KEY], F.desc("order_freq"), F.asc("first_row")], "_at", keep=keep)
    start = at.groupBy(*KEY).agg(F.min("_at").alias("_start"))
    return by_column(at, start).withColumn("rn", F.col("_at") - F.col("_start") + 1).drop("_at", "_start")


def rank_all_cells(cells: DataFrame, lake_freq: DataFrame) -> DataFrame:
    """``(table_id, col_name, value, rn)``: :func:`rank_all_values` of the cells' values by
    lake frequency.  Values are grouped, joined and sorted by their :func:`short_key`;
    those longer than VALUE_CUT move once themselves, to come back behind their rank."""
    cells = cells.where(F.col("value").isNotNull())
    freq = lake_freq.select(short_key(F.col("value")).alias("value"), "freq")
    ranked = rank_all_values(short_groups(cells), freq, written).select(*KEY, "value", "rn", "len")
    long = (cells.where(F.length("value") > VALUE_CUT).groupBy(*KEY, short_key(F.col("value")).alias("_key"))
            .agg(F.first("value").alias("value")))
    found = ranked.where(F.col("len") > VALUE_CUT).withColumnRenamed("value", "_key").join(long, [*KEY, "_key"])
    out = [*KEY, "value", "rn"]
    return ranked.where(F.col("len") <= VALUE_CUT).select(*out).unionByName(found.select(*out))


def sample_values(ranked: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """P2 + W2: the longest prefix of the ranking whose token cost fits the
    budget (cost = tokens of the 200-char cut + 1 separator after the first);
    a first value over budget is kept alone (cut to 2*budget chars).

    Costs are >= 0, so the prefix equals a running-sum filter; each value after
    the first costs >= 1, so only rn <= budget + 1 can qualify and the running
    window sees a bounded number of rows per column."""
    cut = F.substring("value", 1, VALUE_CUT)
    r = (ranked.where(F.col("rn") <= budget + 1)
         .withColumn("cut", cut)
         .withColumn("ntok", n_words(F.col("cut")))
         .withColumn("cost", F.col("ntok") + F.when(F.col("rn") > 1, 1).otherwise(0)))
    w = Window.partitionBy(*KEY).orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("cum", F.sum("cost").over(w))
    first_over = (F.col("rn") == 1) & (F.col("ntok") > budget)
    return (r.where((F.col("cum") <= budget) | first_over)
            .select(*KEY, "rn", F.when(first_over, F.substring("cut", 1, 2 * budget))
                    .otherwise(F.col("cut")).alias("value")))


def sampled_text(sample: DataFrame) -> DataFrame:
    """(table_id, col_name, values_text): sampled values in rank order."""
    return (sample.groupBy(*KEY)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                                          lambda x: x["value"]), VALUE_JOIN).alias("values_text")))


def column_text(lake: Lake, pattern: str = "title-colname-stat-col", lake_freq: DataFrame | None = None,
                budget: int = DEFAULT_BUDGET, cells: DataFrame | None = None,
                columns: DataFrame | None = None) -> DataFrame:
    """(table_id, col_name, text) for every column of the lake.

    ``cells`` / ``columns`` restrict the work (e.g. to key columns)."""
    if pattern not in PATTERNS:
        pattern = "default"
    cells = lake.cells if cells is None else cells
    columns = lake.columns if columns is None else columns
    groups = short_groups(cells)
    if lake_freq is not None:
        lake_freq = lake_freq.select(short_key(F.col("value")).alias("value"), "freq")
    prof = column_profile(groups)
    # by the length, an aggregate: a filter on the value would go below the groups, and they would be made twice;
    # as they would without the frequency, which the profile needs and a ranking by ``lake_freq`` does not
    ranked = rank_values(groups.where(F.col("len").isNotNull() & (F.col("freq") > 0)), lake_freq, limit=budget + 1)
    vals = sampled_text(sample_values(ranked, budget))
    cols = columns.select(*KEY).distinct()
    if pattern == "title-colname-col":  # the only pattern that prints the table name
        cols = cols.join(lake.tables.select("table_id", "table_name"), "table_id", "left")
    else:
        cols = cols.withColumn("table_name", F.col("table_id"))
    base = cols.join(prof, KEY, "left").join(vals, KEY, "left")
    v = F.coalesce(F.col("values_text"), F.lit(""))
    stat = F.concat(F.col("col_name"), F.lit(" contains "), F.coalesce("n_distinct", F.lit(0)).cast("string"),
                    F.lit(" values ("), F.coalesce("max_len", F.lit(0)).cast("string"), F.lit(", "),
                    F.coalesce("min_len", F.lit(0)).cast("string"), F.lit(", "),
                    fmt_1f(F.coalesce("avg_len", F.lit(0.0))), F.lit("): "), v)
    if pattern == "col":
        text = v
    elif pattern == "colname-col":
        text = F.concat(F.col("col_name"), F.lit(": "), v)
    elif pattern in ("colname-stat-col", "title-colname-stat-col"):
        text = stat
    elif pattern == "title-colname-col":
        text = F.concat(F.coalesce("table_name", "table_id"), F.lit(". "), F.col("col_name"), F.lit(": "), v)
    else:
        text = F.concat(F.col("table_id"), F.lit(". "), stat)
    return base.select(*KEY, text.alias("text"))
