"""BPE encoding and decoding with forced-boundary splitting.

A byte pair (a, b) that occurs inside no vocabulary token can never be merged
over, so a cut between a and b is certain.  The 256 x 256 table of such pairs
is computed from the vocabulary.  Documents are cut at them, vectorised over a
whole Arrow batch; the fragments are encoded independently, each distinct one
once per task (a bounded cache), and their ids are concatenated.

The tokenizer also cuts texts with a pattern before merging, and the pattern
looks at what stands around a cut.  A forced pair is therefore used only where
the pattern gives the same pieces on both sides: never inside a UTF-8
character, never after white space (the pattern treats the end of a run of
white space according to what follows) and never before an apostrophe that
does not follow a letter or digit (it could start a contraction).  Strings of
added tokens are found in the whole text first and are fragments of their own.

Edge cases: a null text is an empty text, with no ids and the empty text as
its decoding; null ids decode to the empty text; other columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejoin.llm import shared, words

CACHE = 200_000       # distinct fragments a task remembers
SLICE = 256           # documents per output batch


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    if all(c in alphabet for c in token):
        return bytes(alphabet[c] for c in token)
    return token.encode()


def forced_pairs(spec: dict) -> np.ndarray:
    """forced[a, b]: no vocabulary token holds byte a followed by byte b."""
    alphabet = byte_alphabet()
    forced = np.ones((256, 256), dtype=bool)
    for token in spec["model"]["vocab"]:
        raw = np.frombuffer(token_bytes(token, alphabet), np.uint8)
        forced[raw[:-1], raw[1:]] = False
    return forced


def _white(b: np.ndarray) -> np.ndarray:
    """True at the last byte of a white-space character."""
    out = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D)) | ((b >= 0x1C) & (b <= 0x1F))
    high = np.flatnonzero(b >= 0x80)
    if len(high):
        p1 = np.where(high >= 1, b[high - 1], 0)
        p2 = np.where(high >= 2, b[high - 2], 0)
        x = b[high]
        out[high] = (((p1 == 0xC2) & ((x == 0x85) | (x == 0xA0)))
                     | ((p2 == 0xE1) & (p1 == 0x9A) & (x == 0x80))
                     | ((p2 == 0xE2) & (p1 == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)))
                     | ((p2 == 0xE2) & (p1 == 0x81) & (x == 0x9F))
                     | ((p2 == 0xE3) & (p1 == 0x80) & (x == 0x80)))
    return out


_ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _ALNUM[_lo:_hi] = True


def cuts(raw: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """Byte positions at which the text is certainly cut."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    a, b = raw[:-1], raw[1:]
    ok = forced[a, b]
    ok &= (b & 0xC0) != 0x80
    ok &= ~_white(raw)[:-1]
    ok &= (b != 0x27) | _ALNUM[a]
    return np.flatnonzero(ok) + 1


class Codec:
    """Encoder and decoder of one task; the encoder's parts are built on first use."""

    def __init__(self, spec_json: str):
        self.spec = json.loads(spec_json)
        self.spec["truncation"] = self.spec["padding"] = None
        self.cache: dict[bytes, np.ndarray] = {}
        added = self.spec.get("added_tokens") or []
        self.added = [re.escape(t.encode()) for t in sorted((t["content"] for t in added), key=len, reverse=True)]

    @cached_property
    def tok(self):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_str(json.dumps(self.spec))

    @cached_property
    def forced(self) -> np.ndarray:
        return forced_pairs(self.spec)

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        alphabet = byte_alphabet()
        special = {t["id"]: t["content"].encode() for t in self.spec.get("added_tokens") or []}
        return {i: token_bytes(t, alphabet) for t, i in self.spec["model"]["vocab"].items()} | special

    def fragments(self, raw: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        at = cuts(raw, self.forced).tolist()
        if self.added:
            spans = [m.span() for m in re.finditer(b"|".join(self.added), data)]
            if spans:        # an added token is a fragment; no other cut lies inside it
                inside = lambda p: any(s < p < e for s, e in spans)
                at = sorted({p for p in at if not inside(p)} | {p for s in spans for p in s} - {0, len(data)})
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])] if data else []

    def encode(self, raw: np.ndarray) -> list[np.ndarray]:
        """Ids of the fragments, in order."""
        parts = self.fragments(raw)
        cache = self.cache
        new = [f for f in dict.fromkeys(parts) if f not in cache]
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list(dict.fromkeys(parts))
            for f, e in zip(new, self.tok.encode_batch([f.decode() for f in new], add_special_tokens=False)):
                cache[f] = e.ids
        return [cache[f] for f in parts]

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _ids(codec: Codec, col: pa.Array) -> pa.ListArray:
    raw, offsets = words.text_buffers(col)
    flat, ends = [np.zeros(0, np.int32)], [0]
    for i in range(len(col)):
        ids = list(chain.from_iterable(codec.encode(raw[offsets[i]:offsets[i + 1]])))
        flat.append(np.asarray(ids, dtype=np.int32))
        ends.append(ends[-1] + len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))


def _texts(codec: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([codec.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in ids], pa.string())


def _columns(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _mapped(df: DataFrame, spec_json: str, types: list[str], new: Callable[[Codec, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``new`` makes of slices of a batch.
    ``spec_json``: content of a byte-level BPE tokenizer file, a constant of the
    vocabulary's size, sent to the tasks."""
    spec = df.sparkSession.sparkContext.broadcast(spec_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                cols = [*part.columns, *new(codec, part)]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return shared.mapped(plain, run, _columns(plain) + ", ".join(
        f"c{len(df.columns) + i} {t}" for i, t in enumerate(types)))


def encode(df: DataFrame, spec_json: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (array<int>)."""
    at, name = df.columns.index(text_col), shared.fresh(df.columns, ids_col)
    out = _mapped(df, spec_json, ["array<int>"], lambda codec, part: [_ids(codec, part.column(at))])
    return out.toDF(*df.columns, name)


def decode(df: DataFrame, spec_json: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text of ``ids_col``, special tokens included."""
    at, name = df.columns.index(ids_col), shared.fresh(df.columns, text_col)
    out = _mapped(df, spec_json, ["string"], lambda codec, part: [_texts(codec, part.column(at))])
    return out.toDF(*df.columns, name)


def digests(df: DataFrame, spec_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and digest: id, n_tokens, ids_sha256, decoded_sha256.
    One Python worker a task does both, so an executor holds one codec a core."""
    def both(codec: Codec, part: pa.RecordBatch) -> list[pa.Array]:
        ids = _ids(codec, part.column(1))
        return [ids, _texts(codec, ids)]

    out = _mapped(df.select(id_col, text_col), spec_json, ["array<int>", "string"], both).toDF(id_col, text_col, "ids", "decoded")
    return out.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
