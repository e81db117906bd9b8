"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Of every ``WINDOW`` = 9 consecutive word 5-grams the smallest hash is kept as a
fingerprint.  A span of 13 words holds nine 5-grams, and which of them is kept
depends on the span alone, so two texts that share 13 words share a
fingerprint at the same place: the guarantee of winnowing.  Fingerprints of
documents and benchmark items are joined, and each hit is extended word by
word, eight to either side, which covers every 13-word span that holds it.  A
matching run of 13 words or more is a hit.  An item with fewer words is one
window: its whole hash is looked up among the document's runs of that length.

Documents go through one Python pass over Arrow batches; it emits only
fingerprints, with 21 word hashes around each.  If the benchmark has at most
``FILTER_MAX`` fingerprints (checked by a count), their sorted list is
broadcast and other fingerprints are left out of the join early; with more,
all take part in the same shuffle join.  The results are the same.

Edge cases: a null or wordless text has 0 words and is clean; a benchmark item
without words has no window; items with equal ids count once; a null item id
reads as the empty string; repeated rows get a result each; an empty table on
either side gives clean documents or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, words

SPAN = 13                     # words of a window
GRAM = 5
WINDOW = SPAN - GRAM + 1      # grams of which the smallest is kept
REACH = SPAN - GRAM           # words to look at on either side of a fingerprint
FILTER_MAX = 1 << 20          # fingerprints that may be broadcast (8 MB)
_HIT = "array<struct<m:int,fp:bigint,pos:int,ctx:array<bigint>>>"


def _kept(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Word positions whose 5-gram is the smallest of some window (all ties are
    kept, so the choice depends on the window's words alone)."""
    g = words.grams(h, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.minimum(g[:-1], g[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])            # smallest of 8
    low = np.minimum(low[:n], g[WINDOW - 1:])      # of 9
    ok = np.zeros(n, dtype=bool)                   # windows that stay inside one document
    lens = np.diff(bounds)
    doc_end = np.repeat(bounds[1:], lens)
    at = np.arange(n)
    ok = at + SPAN <= doc_end[:n]
    keep = np.zeros(len(g), dtype=bool)
    for d in range(WINDOW):
        keep[d:d + n] |= ok & (g[d:d + n] == low)
    return np.flatnonzero(keep)


def _context(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, pad: int) -> np.ndarray:
    """Word hashes from REACH before to REACH after each 5-gram, inside its document."""
    idx = at[:, None] + np.arange(-REACH, GRAM + REACH)[None, :]
    out = np.full(idx.shape, pad, dtype=np.uint64)
    ok = (idx >= lo[:, None]) & (idx < hi[:, None])
    out[ok] = h[idx[ok]]
    return out.view(np.int64)


class _Filter:
    """Membership in a sorted list of hashes; a bit table rejects most at once."""

    def __init__(self, fps: np.ndarray):
        self.fps = np.sort(fps.view(np.uint64))
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[(self.fps >> np.uint64(42)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.fps):
            return np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.fps, h[at]), len(self.fps) - 1)
        return at[self.fps[i] == h[at]]


def _hits(col: pa.Array, lengths: list[int], accept: _Filter | None, pad: int, whole: bool):
    """For each document of a batch: (number of words, hits).  ``whole``: short
    texts are one window (benchmark side); else runs of ``lengths`` words are
    looked up (document side)."""
    for w in words.words(col, words.ALNUM):
        h, bounds = w.hashes, w.bounds
        n_docs = len(bounds) - 1
        lens = np.diff(bounds)
        doc_of = np.repeat(np.arange(n_docs), lens)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []   # doc, m, fp, position
        at = _kept(h, bounds)
        g = words.grams(h, GRAM)
        if accept is not None and len(at):
            at = at[accept.of(g[at])]
        if len(at):
            rows.append((doc_of[at], np.zeros(len(at), np.int64), g[at].view(np.int64), at))
        for m in lengths:
            gm = words.grams(h, m, salt=m)
            if not len(gm):
                continue
            ok = np.arange(len(gm)) + m <= np.repeat(bounds[1:], lens)[:len(gm)]
            if whole:
                ok &= (lens[doc_of[:len(gm)]] == m)
            pos = np.flatnonzero(ok)
            if accept is not None and len(pos):
                pos = pos[accept.of(gm[pos])]
            if len(pos):
                rows.append((doc_of[pos], np.full(len(pos), m), gm[pos].view(np.int64), pos))
        per: dict[int, list] = {}
        for doc, m, fp, pos in rows:
            if m[0] == 0:
                ctx = _context(h, pos, bounds[doc], bounds[doc + 1], pad).tolist()
            else:
                ctx = [[]] * len(pos)
            start = bounds[doc]
            for d, a, b, p, c in zip(doc.tolist(), m.tolist(), fp.tolist(), (pos - start).tolist(), ctx):
                per.setdefault(d, []).append({"m": a, "fp": b, "pos": p, "ctx": c})
        for d in range(n_docs):
            yield int(lens[d]), per.get(d, [])


_ARROW_HITS = pa.list_(pa.struct([("m", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("ctx", pa.list_(pa.int64()))]))


def _scan(df: DataFrame, text: str, lengths: list[int], accept, pad: int, whole: bool) -> DataFrame:
    """Replace the text column by n_words and hits."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fil = None
        if accept is not None:
            fil = _Filter(np.asarray(accept.value, dtype=np.int64))
        for batch in batches:
            n_words, hits = [], []
            for n, h in _hits(batch.column(text), lengths, fil, pad, whole):
                n_words.append(n)
                hits.append(h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(hits, _ARROW_HITS)],
                names=keep + ["n_words", "hits"])

    return shared.mapped(df, run, f"{schema}, n_words bigint, hits {_HIT}" if keep else f"n_words bigint, hits {_HIT}")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", filter_max: int = FILTER_MAX) -> DataFrame:
    """One row per document: ``id_col``, ``text_key`` (xxhash64 of the text),
    n_words, n_hit, ``spans`` (array of (start, end) word runs that match),
    ``items`` (sorted ids as strings), contaminated."""
    spark = docs.sparkSession
    items = shared.staged(_scan(
        bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                     F.coalesce(F.col(item_text), F.lit("")).alias("text")),
        "text", list(range(1, SPAN)), None, 1, True))
    marks = (items.select("item", F.inline("hits")).drop("pos").distinct()
             .withColumnRenamed("ctx", "item_ctx"))
    marks = shared.staged(marks)
    # the lengths of short items: at most 12 values
    lengths = sorted(r[0] for r in marks.filter("m > 0").select("m").distinct().collect())
    fps = marks.select("fp").distinct()
    accept = None
    if len(fps.limit(filter_max + 1).collect()) <= filter_max:      # at most filter_max + 1 longs
        accept = spark.sparkContext.broadcast([r[0] for r in fps.collect()])
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = shared.staged(_scan(base, "text", lengths, accept, 0, False))
    found = seen.filter(F.size("hits") > 0).select("rid", F.inline("hits")).join(marks, ["m", "fp"])
    eq = F.zip_with("ctx", "item_ctx", lambda a, b: a == b)
    run = lambda part: F.when(F.array_position(part, False) == 0, F.size(part)).otherwise(
        F.array_position(part, False).cast("int") - 1)
    found = (found.withColumn("eq", eq)
             .withColumn("left", F.when(F.col("m") > 0, 0).otherwise(run(F.reverse(F.slice("eq", 1, REACH)))))
             .withColumn("right", F.when(F.col("m") > 0, F.col("m"))
                         .otherwise(GRAM + run(F.slice("eq", REACH + GRAM + 1, REACH))))
             .filter((F.col("m") > 0) | (F.forall(F.slice("eq", REACH + 1, GRAM), lambda e: e)
                                         & (F.col("left") + F.col("right") >= SPAN)))
             .select("rid", "item", (F.col("pos") - F.col("left")).alias("start"),
                     (F.col("pos") + F.col("right")).alias("end")).distinct())
    found = shared.staged(found)
    n_hit = (found.select("rid", "start", "end").distinct()
             .select("rid", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
             .groupBy("rid").agg(F.count("*").alias("n_hit")))
    named = found.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"),
                                     F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    out = seen.drop("hits").join(n_hit, "rid", "left").join(named, "rid", "left")
    n = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "text_key", "n_words", n.alias("n_hit"),
                      F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
                      ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, **names) -> DataFrame:
    """Documents that are not contaminated, columns as they were.  A verdict
    depends on the text alone, so rows are matched by the hash of their text
    and null or repeated ids need no care."""
    text = names.get("text_col", "text")
    bad = shared.staged(contamination(docs, bench, **names).filter("contaminated").select("text_key").distinct())
    key = shared.fresh(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return shared.without(keyed, bad.withColumnRenamed("text_key", key), key).drop(key)
