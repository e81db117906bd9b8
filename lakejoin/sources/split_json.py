"""Table documents out of large JSON files, read by many tasks.

A file is one JSON text: an array of table objects, an object with the array
under ``tables``, or a single table object.  Spark's text source reads it in
splits with ``}`` as the line separator, so each row is a piece that ends where
an object may end.  Whether it does depends on what came before: inside a string
a brace means nothing, and other braces and brackets count the depth.

1. Each block (split of a file) returns a summary: the parity of its quotes, and
   its change of depth should it begin outside or inside a string.  Running
   sums over a file's blocks give the state each block begins in: one row a
   block, in Spark.
2. With that state each block cuts its pieces where an object of the array ends.
   Objects that lie in one block come out at once; of the others only the
   fragments at block borders meet, by their order.

Quotes after an odd number of backslashes belong to the string.  A block border
is a piece border, so no escape is ever cut.  Compressed files are one block.

Edge cases: white space and line breaks anywhere; braces and quotes in strings;
objects inside objects; an empty array gives no rows; members of an array that
are no objects are left out; a file that begins with neither bracket nor brace
raises an error; an object cut off in the middle comes out as it is and does
not parse.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakejoin.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCAN_BYTES = 1 << 18     # text looked through at once: the positions take some thirty times its size

_WRAPPER = r'(?s)^\s*\{.*"tables"\s*:\s*\['


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "}").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of braces and brackets, +1 or -1, quotes before each) of some pieces."""
    b = np.frombuffer(text, dtype=np.uint8)
    at = np.arange(len(b))
    quote = np.flatnonzero(b == 0x22)
    plain = np.maximum.accumulate(np.where(b != 0x5C, at, -1))            # the last byte that is no backslash
    slashes = quote - 1 - np.where(quote > 0, plain[quote - 1], -1)
    quote = quote[slashes % 2 == 0]
    brace = np.flatnonzero((b == 0x7B) | (b == 0x7D) | (b == 0x5B) | (b == 0x5D))
    return brace, np.where((b[brace] == 0x7B) | (b[brace] == 0x5B), 1, -1), np.searchsorted(quote, brace)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.RecordBatch]]:
    """Slices of the batches that lie in one block; the flag marks a block's first."""
    at = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
                here = (files[start], blocks[start])
                yield *here, here != at, batch.slice(start, i - start)
                at, start = here, i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, outside, inside) of each slice of a block, SCAN_BYTES at once."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
    for file, block, _, part in _runs(batches):
        for text in _texts(part):
            _, step, before = _scan(text)
            n = text.count(b'"')
            quotes = n if b"\\" not in text else len(_real_quotes(text))
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "odd": quotes % 2, "outside": int(step[before % 2 == 0].sum()),
                                               "inside": int(step[before % 2 == 1].sum())}], schema=schema)


def _texts(part: pa.RecordBatch) -> Iterator[bytes]:
    """The pieces of a slice, joined up to SCAN_BYTES; each piece is whole."""
    held, size = [], 0
    for value in part.column("value"):
        held.append((value.as_py() or "").encode())
        size += len(held[-1]) + 1
        if size >= SCAN_BYTES:
            yield b"}".join(held) + b"}"
            held, size = [], 0
    if held:
        yield b"}".join(held) + b"}"


def _real_quotes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, dtype=np.uint8)
    quote = np.flatnonzero(b == 0x22)
    plain = np.maximum.accumulate(np.where(b != 0x5C, np.arange(len(b)), -1))
    return quote[(quote - 1 - np.where(quote > 0, plain[quote - 1], -1)) % 2 == 0]


def _block_states(pieces: DataFrame) -> DataFrame:
    """(file, block, in_string, depth): how each block but a file's first begins.
    A slice of a block is numbered within it, so slices compose like blocks."""
    parts = pieces.select("file", "block", "value").mapInArrow(
        _summaries, "file string, block bigint, odd int, outside bigint, inside bigint").withColumn("nth", F.monotonically_increasing_id())
    parts = cut_lineage(parts)
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("in_string", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    step = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    parts = parts.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long"))
    return (parts.where("block > 0").groupBy("file", "block").agg(F.min_by(F.struct("in_string", "depth"), "nth").alias("s"))
            .select("file", "block", "s.in_string", "s.depth"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, lead, whole, text): the array's objects and fragments of them.
    ``lead``: it goes on from the block before; ``whole``: it begins and ends here."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("lead", pa.bool_()), ("whole", pa.bool_()), ("text", pa.string())])
    held: list[str] = []
    file = block = None
    n, lead, depth, in_string, base = 0, False, 0, 0, 1

    def row(text: str, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": file, "block": block, "n": n, "lead": lead, "whole": whole, "text": text}], schema=schema)

    for f, b, new, part in _runs(batches):
        if new:
            if held:
                yield row("".join(held), False)
            file, block, n, held = f, b, 0, []
            first = part.slice(0, 1).to_pylist()[0]
            depth, in_string, base = first["depth"] or 0, first["in_string"] or 0, first["base"]
            lead = depth > base
        out, size = [], 0
        for value in part.column("value"):
            piece = (value.as_py() or "") + "}"
            text = piece.encode()
            at, step, before = _scan(text)
            real = (before + in_string) % 2 == 0
            at, depths = at[real], depth + np.cumsum(step[real])
            open_ = 0 if held or depth > base else None        # byte from which the piece belongs to an object
            if open_ is None:
                begins = np.flatnonzero((depths == base + 1) & (step[real] == 1) & (np.frombuffer(text, np.uint8)[at] == 0x7B))
                if len(begins):
                    open_ = int(at[begins[0]])
            if open_ is not None:
                held.append(text[open_:].decode())
            in_string = (in_string + (text.count(b'"') if b"\\" not in text else len(_real_quotes(text)))) % 2
            depth = max(int(depths[-1]) if len(depths) else depth, 0)
            if open_ is not None and depth <= base:
                out.append({"file": file, "block": block, "n": n, "lead": lead, "whole": not lead, "text": "".join(held)})
                held, lead, n = [], False, n + 1
                size += len(out[-1]["text"])
                if size >= SCAN_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield row("".join(held), False)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, n, value)``: the JSON text of every table object; ``block``
    and ``n`` give the order within the file."""
    pieces = _pieces(spark, path)
    # one row a block but the first of each file; the pieces must keep their order, so nothing else may move
    states = F.broadcast(_block_states(pieces))
    # how deep the objects of the array stand: in an array, in an array of an object, or the file is one object
    head = (pieces.where("block = 0").withColumn("nth", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "nth").alias("head"))
            .withColumn("start", F.substring(F.regexp_replace("head", r"^\s+", ""), 1, 1))
            .select("file", F.when(F.col("head").rlike(_WRAPPER), 2).when(F.col("start") == "{", 0).when(F.col("start") == "[", 1)
                    .otherwise(F.raise_error(F.concat(F.lit("unreadable table document "), F.col("file"), F.lit(": no readable JSON"))).cast("int")).alias("base")))
    head = F.broadcast(cut_lineage(head.where("base <> 1")))                   # files that are no plain array
    known = (pieces.join(states, ["file", "block"], "left").join(head, "file", "left")
             .select("file", "block", "value", "in_string", "depth", F.coalesce("base", F.lit(1)).alias("base")))
    # read several times, by each relation of the lake: cut once
    got = cut_lineage(known.mapInArrow(_cut, "file string, block bigint, n bigint, lead boolean, whole boolean, text string"))
    parts = cut_lineage(got.where("not whole"))                                # at most two a block
    order = Window.partitionBy("file").orderBy("block", "n")
    parts = parts.withColumn("of", F.sum(F.when(F.col("lead"), 0).otherwise(1)).over(order))
    joined = (parts.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("p"))
              .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["n"].alias("n"),
                      F.array_join(F.transform("p", lambda x: x["text"]), "").alias("value")))
    return got.where("whole").select("file", "block", "n", F.col("text").alias("value")).unionByName(joined)
