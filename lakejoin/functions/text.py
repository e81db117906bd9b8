"""Text expressions: tokens, number formatting and the serialisations P3-P6.

All are built-in Spark expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text formats.
SEP = " [SEP] "
EMPTY_TEXT = "empty"
NO_DESCRIPTION = "No description available"
VALUE_JOIN = ", "
DEFAULT_K = 30
WORD_PATTERN = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits of any script (the built-in token counter)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def n_words(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Python-style ``str.strip()`` (all leading / trailing whitespace)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fmt_dec(x: Column, digits: int) -> Column:
    """``f"{x:.Nf}"`` (half-even on the binary value, no grouping commas)."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def fmt_1f(x: Column) -> Column:
    return fmt_dec(x, 1)


def cell_text(name: Column, value: Column) -> Column:
    """``name : value`` (value stripped) or ``name :`` for null / blank."""
    v = strip(value)
    return F.when(value.isNull() | (v == ""), F.concat(name, F.lit(" :"))) \
        .otherwise(F.concat(name, F.lit(" : "), v))


def joined_values(values: Column, max_values: int) -> Column:
    """P3 inner part: order-preserving distinct, then the first ``max_values``,
    then drop null / empty, joined by ', '."""
    kept = F.filter(F.slice(F.array_distinct(values), 1, max_values),
                    lambda x: x.isNotNull() & (x != ""))
    return F.array_join(kept, VALUE_JOIN)


def column_part(name: Column, values: Column, max_values: int) -> Column:
    """``name : v1, v2`` or NULL when nothing is left."""
    j = joined_values(values, max_values)
    return F.when(j != "", F.concat(name, F.lit(" : "), j))


def join_parts(parts: Column, empty: str = EMPTY_TEXT) -> Column:
    """Join non-null parts by ' [SEP] ' (``empty`` when none)."""
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, SEP)).otherwise(F.lit(empty))


def serialize_descriptions(names: Column, descs: Column) -> Column:
    """``col : desc`` for non-blank descriptions, else the fixed sentence."""
    parts = F.zip_with(names, descs, lambda c, d: F.when(
        c.isNotNull() & d.isNotNull() & (strip(d) != ""), F.concat(c, F.lit(" : "), strip(d))))
    return join_parts(parts, NO_DESCRIPTION)


def serialize_row(names: Column, values: Column) -> Column:
    """P5: ``col : val`` for non-empty values joined by ' [SEP] ', else 'empty'."""
    parts = F.zip_with(names, values, lambda c, v: F.when(
        c.isNotNull() & v.isNotNull() & (v != ""), F.concat(c, F.lit(" : "), v)))
    return join_parts(parts, EMPTY_TEXT)


def parse_int_list(text: Column) -> Column:
    """Comma list -> distinct sorted ints, blanks dropped; [30] when none is left."""
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    ints = F.transform(F.filter(items, lambda x: x != ""), lambda x: x.cast("int"))
    kept = F.array_sort(F.array_distinct(F.filter(ints, lambda x: x.isNotNull())))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(DEFAULT_K)))


def parse_key_indices(text: Column) -> Column:
    """Comma list -> ints in their order, repeats kept; NULL (no override) for
    null or blank text.  A blank or non-numeric item is an error, as in a strict parse."""
    items = F.transform(F.split(text, ",", -1), lambda x: strip(x).cast("int"))
    return F.when(text.isNotNull() & (strip(text) != ""), items)
