"""Language ID by prediction by partial matching (PPM).

For each language a byte context tree of order two is counted over all training
texts: how often each byte follows each two-byte, one-byte and empty context.
The statistics are then frozen.  A byte's code length in a language is exact
PPM with escape method C: with n symbols and d different ones seen in a
context, a seen byte costs -log2(count / (n + d)); an unseen one costs the
escape -log2(d / (n + d)) plus its cost in the next shorter context; below the
empty context all 256 bytes are equally likely.  A context never seen costs
nothing and is passed over.  The language with the shortest code for the whole
text wins.

Counting and scoring are passes over Arrow batches.  Counts are pre-aggregated
in each task and summed by Spark.  The model keeps every (language, trigram) row
of every language, at most 2^24 a language, as sorted codes with their lengths.
Languages are dealt into blocks of about BLOCK numbers (one language at least);
the driver builds and sends one block after the other, and a task that meets
more than one holds a run of texts and one block at a time and takes the minimum
over the blocks.  Texts are lower-cased first.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
rows without language or with a null id are not learned from; equal code
lengths go to the first language by name; with nothing to learn from every
text is ``und``; repeated rows get a result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, words

CODES = 1 << 24
BLOCK = 1 << 24       # codes and lengths in one block of languages; no limit to the model
HELD = 1 << 22        # counts that a task holds before it passes them on
CHUNK = 1 << 20
RUN = 1 << 25         # bytes of text that a task holds while it goes through several blocks


def _trigrams(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code (two bytes before, byte) of every byte; before a text stand zeros."""
    n = len(raw)
    b = raw.astype(np.uint32)
    p1 = np.zeros(n, np.uint32)
    p1[1:] = b[:-1]
    p2 = np.zeros(n, np.uint32)
    p2[2:] = b[:-2]
    starts = starts[starts < n]
    p1[starts] = 0
    p2[starts] = 0
    second = starts + 1
    p2[second[second < n]] = 0
    return p2 << np.uint32(16) | p1 << np.uint32(8) | b


def _parts(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets) in runs of about CHUNK bytes; a longer
    text comes as runs of its own (contexts start anew at their edges)."""
    raw, offsets = words.text_buffers(col)
    doc = 0
    while doc < len(col):
        last = min(max(int(np.searchsorted(offsets, offsets[doc] + CHUNK, side="right")) - 1, doc + 1), len(col))
        lo, hi = int(offsets[doc]), int(offsets[last])
        if last == doc + 1 and hi - lo > CHUNK:
            for a in range(lo, hi, CHUNK):
                z = min(a + CHUNK, hi)
                yield doc, raw[a:z], np.array([0, z - a])
        else:
            yield doc, raw[lo:hi], offsets[doc:last + 1] - lo
        doc = last


def count(texts: DataFrame) -> DataFrame:
    """(lang, code, n) over ``texts`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def fold(lang):
            codes = np.concatenate([c for c, _ in held[lang]])
            ns = np.concatenate([n for _, n in held[lang]])
            u, inv = np.unique(codes, return_inverse=True)
            held[lang] = [(u, np.bincount(inv, weights=ns).astype(np.int64))]
            return len(u) - len(codes)

        def flush():
            for name in list(held):
                fold(name)
                codes, ns = held.pop(name)[0]
                for lo in range(0, len(codes), 1 << 16):
                    c = codes[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(c)), pa.array(c.astype(np.int64)), pa.array(ns[lo:lo + (1 << 16)])], names=["lang", "code", "n"])

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for k, name in enumerate(names):
                own = batch.column("text").filter(pa.array(index == k))
                for _, raw, off in _parts(own):
                    held.setdefault(name, []).append(np.unique(_trigrams(raw, off[:-1]), return_counts=True))
                    size += len(held[name][-1][0])
                    if len(held[name]) > 64:
                        size += fold(name)
                    if size > HELD:
                        size += sum(fold(x) for x in held)
                        if size > HELD // 2:
                            yield from flush()
                            size = 0
        yield from flush()

    return (texts.mapInArrow(run, "lang string, code bigint, n bigint")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    languages: list[str]
    row_of: list[np.ndarray]   # by language: its sorted codes; a code's row is its place
    bits: list[np.ndarray]     # by language: length of each row, escape of each two-byte context, order-one length of each pair


@dataclass
class Counts:
    rows: DataFrame            # (lang, code, n), written
    blocks: list[list[str]]    # languages in the order of their names


def _lengths(codes: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row_of, bits) of one language from its counts."""
    order = np.argsort(codes)
    codes, ns = codes[order].astype(np.uint32), ns[order].astype(np.float64)

    def ppm(c: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths from counts [context, byte] and those of the shorter context."""
        n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(c / (n + d))
            escape = -np.log2(d / (n + d)) + shorter
        return np.where(n == 0, shorter, np.where(c > 0, seen, escape))

    c1 = np.bincount(codes & 0xFFFF, weights=ns, minlength=65536).reshape(256, 256)
    b1 = ppm(c1, ppm(c1.sum(axis=0, keepdims=True), np.full((1, 256), 8.0)))
    context = codes >> 8
    n, d = np.bincount(context, weights=ns, minlength=65536), np.bincount(context, minlength=65536)
    escape = np.zeros(65536)
    escape[d > 0] = -np.log2(d[d > 0] / (n + d)[d > 0])
    return codes, np.concatenate([-np.log2(ns / (n + d)[context]), escape, b1.ravel()]).astype(np.float32)


def build(counts: dict[str, dict[int, int]]) -> Model:
    """Freeze counts {language: {code: n}} into code lengths."""
    langs = sorted(counts)
    made = [_lengths(np.fromiter(counts[x], np.int64, len(counts[x])), np.fromiter(counts[x].values(), np.int64, len(counts[x]))) for x in langs]
    return Model(langs, [r for r, _ in made], [b for _, b in made])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Counts:
    """Counts of all rows of ``docs`` with a language."""
    rows = count(docs.filter(F.col(lang_col).isNotNull())
                 .select(F.col(lang_col).alias("lang"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    rows = shared.staged(rows)
    blocks, size = [], BLOCK
    for lang, n in sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()):
        own = 2 * (n + 65536)
        if not blocks or size + own > BLOCK:
            blocks, size = [*blocks, []], 0
        blocks[-1].append(lang)
        size += own
    return Counts(rows, blocks)


def block(model: Counts, langs: list[str]) -> Model:
    """Code lengths of the languages of one block."""
    at = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int")
    got = model.rows.filter(F.col("lang").isin(langs)).select(at.alias("at"), F.col("code").cast("int").alias("code"), "n").toArrow()
    at, codes, ns = (got.column(c).to_numpy() for c in ("at", "code", "n"))
    made = [_lengths(codes[own], ns[own]) for own in (at == k + 1 for k in range(len(langs)))]
    return Model(langs, [r for r, _ in made], [b for _, b in made])


def code_lengths(col: pa.Array, n_lang: int, row_of: list[np.ndarray], bits: list[np.ndarray]) -> np.ndarray:
    """Bits of each text in each language: the different codes of a run of texts
    are looked up once a language, then summed over the texts."""
    out = np.zeros((len(col), n_lang))
    mark, place = np.zeros(CODES, bool), np.empty(CODES, np.uint32)
    for doc, raw, off in _parts(col):
        if not len(raw):
            continue
        code = _trigrams(raw, off[:-1])
        mark[code] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        place[found] = np.arange(len(found), dtype=np.uint32)
        at = place[code]
        full = np.flatnonzero(np.diff(off))
        for k in range(n_lang):
            own, b = row_of[k], bits[k]
            row = np.searchsorted(own, found.astype(np.uint32))
            seen = np.append(own, np.uint32(CODES))[row] == found
            cost = np.where(seen, b[row], b[len(own) + (found >> 8)] + b[len(own) + 65536 + (found & 0xFFFF)])
            out[doc + full, k] += np.add.reduceat(cost[at], off[:-1][full], dtype=np.float64)
    return out


def _best(col: pa.Array, sent: list) -> tuple[np.ndarray, np.ndarray]:
    """(language, posterior) of each text over all blocks."""
    least, weight, lang = np.full(len(col), np.inf), np.zeros(len(col)), np.full(len(col), "und", object)
    for x in sent:
        languages, row_of, bits = x.value
        cost = code_lengths(col, len(languages), row_of, bits)
        own = cost.min(axis=1)
        w = np.exp2(np.clip(own[:, None] - cost, -1000, 0)).sum(axis=1)
        wins = own < least                               # equal lengths: the first by name
        lang[wins] = np.array(languages, object)[cost.argmin(axis=1)[wins]]
        low = np.minimum(own, least)
        weight = weight * np.exp2(np.clip(low - least, -1000, 0)) + w * np.exp2(np.clip(low - own, -1000, 0))
        least = low
        if len(sent) > 1:
            del languages, row_of, bits
            x.__dict__.pop("_value", None)               # read again from its file for the next run of texts
    return lang, 1.0 / weight


def predict(docs: DataFrame, model: Counts, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (posterior of the winner, equal priors)."""
    names = [shared.fresh(docs.columns, c) for c in ("lang_pred", "score")]
    lower = shared.fresh([*docs.columns, *names], "lower_text")
    sent = []
    for langs in model.blocks:
        m = block(model, langs)
        sent.append(docs.sparkSession.sparkContext.broadcast((m.languages, m.row_of, m.bits)))
        del m
    df = docs.withColumn(lower, F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col)))
    cols = docs.columns
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)

    def score(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col = pa.concat_arrays([x.column(lower) for x in batches])
        lang, p = np.full(len(col), "und", object), np.zeros(len(col))
        if sent:
            known = col.is_valid().to_numpy(zero_copy_only=False)
            lang[known], p[known] = (x[known] for x in _best(col, sent))
        first = 0
        for x in batches:
            own = slice(first, first + x.num_rows)
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in cols], pa.array(lang[own], pa.string()), pa.array(p[own])],
                                             names=[*cols, *names])
            first += x.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            held, size = [*held, x], size + x.nbytes
            if len(sent) < 2 or size > RUN:
                yield from score(held)
                held, size = [], 0
        if held:
            yield from score(held)

    return df.mapInArrow(run, f"{types}`{names[0]}` string, `{names[1]}` double")
