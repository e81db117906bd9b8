"""Table-id and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Partition names recognised in the second '-' part of an id.
PARTITION_NAMES = ["top", "middle", "bottom"]


def infer_base_id(tid: Column) -> Column:
    """Text before the first '-', else before the first '_', else the whole id."""
    return (F.when(tid.contains("-"), F.substring_index(tid, "-", 1))
            .when(tid.contains("_"), F.substring_index(tid, "_", 1))
            .otherwise(tid))


def infer_partition(tid: Column) -> Column:
    """Second '-' part when it names a partition, else 'unknown'."""
    second = F.when(F.size(F.split(tid, "-")) >= 2, F.split(tid, "-").getItem(1))
    return F.when(second.isin(*PARTITION_NAMES), second).otherwise(F.lit("unknown"))


def normalize_name(name: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(name, "\\", "/")


def folder_of(name: Column) -> Column:
    """Folder part of ``folder/name`` (NULL when there is no slash)."""
    n = normalize_name(name)
    return F.when(n.contains("/"), F.regexp_extract(n, r"(?s)^(.*)/[^/]*$", 1))


def leaf_of(name: Column) -> Column:
    """Name part after the last '/'."""
    return F.substring_index(normalize_name(name), "/", -1)


def strip_csv(name: Column) -> Column:
    """Drop a trailing '.csv'."""
    return F.regexp_replace(name, r"\.csv$", "")


def split_column_key(key: Column) -> tuple[Column, Column]:
    """``table::column`` split at the first '::' (column '' when absent)."""
    has = key.contains("::")
    table = F.when(has, F.substring_index(key, "::", 1)).otherwise(key)
    column = F.when(has, F.regexp_extract(key, r"(?s)^.*?::(.*)$", 1)).otherwise(F.lit(""))
    return table, column
