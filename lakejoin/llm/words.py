"""Word hashes over Arrow text buffers, vectorised with numpy.

The bytes of many documents lie next to each other in an Arrow string column.
One prefix sum of a polynomial over the bytes gives the 64-bit hash of every
word (and of every word prefix) without a Python loop over words or bytes.
Two different words collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18      # bytes handled at a time; a longer document is cut between words
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_VAL = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        n = max(n, CHUNK + 4096)
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have


# Word bytes of the two definitions; bytes from 0x80 on belong to words in both.
SPACED = np.ones(256, dtype=bool)                       # [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)                       # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of the documents ``first .. first + len(bounds) - 2`` of a batch."""
    first: int
    bounds: np.ndarray                  # word offsets of the documents
    hashes: np.ndarray                  # one per word
    prefixes: dict[int, np.ndarray]     # hash of the first L bytes, 0 where the word is shorter


def _hash_piece(raw: np.ndarray, breaks: np.ndarray, is_word: np.ndarray, lens: tuple[int, ...]):
    """Word start positions, hashes and prefix hashes of one piece of bytes."""
    b = LOWER[raw]
    n = len(b)
    m = is_word[b]
    cut = np.zeros(n + 1, dtype=bool)
    cut[breaks] = True
    cut[0] = cut[n] = True
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = m[:-1]
    starts = np.flatnonzero(m & (~prev | cut[:n]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = m[1:]
    ends = np.flatnonzero(m & (~nxt | cut[1:])) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VAL[b] * _pow(_BASE, n)[:n], out=total[1:])
    inv = _pow(_INV, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    base = total[starts]
    hashes = mix((total[ends] - base) * inv)
    pre = {}
    for k in lens:
        e = np.minimum(starts + k, n)
        h = mix((total[e] - base) * inv + np.uint64(k))
        h[ends - starts < k] = 0
        pre[k] = h
    return starts, hashes, pre


def _pieces(raw: np.ndarray, is_word: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut one very long document between words."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + limit)
        while end < n:
            stop = np.flatnonzero(~is_word[LOWER[raw[end:min(n, end + 4096)]]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(n, end + 4096)
        yield at, end
        at = end


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(col: pa.Array, is_word: np.ndarray, lens: tuple[int, ...] = (), chunk: int = CHUNK) -> Iterator[Words]:
    """Walk a text column in groups of whole documents of about ``chunk`` bytes."""
    raw, offsets = text_buffers(col)
    doc, n_docs = 0, len(col)
    while doc < n_docs:
        last = int(np.searchsorted(offsets, offsets[doc] + chunk, side="right")) - 1
        last = min(max(last, doc + 1), n_docs)
        lo, hi = int(offsets[doc]), int(offsets[last])
        inner = offsets[doc:last + 1] - lo
        part = raw[lo:hi]
        if hi - lo <= chunk:
            spans = [(0, hi - lo)] if hi > lo else []
        else:
            spans = list(_pieces(part, is_word, chunk))
        starts, hashes, pre = [], [], {k: [] for k in lens}
        for a, z in spans:
            br = inner[(inner >= a) & (inner < z)] - a
            s, h, p = _hash_piece(part[a:z], br, is_word, lens)
            starts.append(s + a)
            hashes.append(h)
            for k in lens:
                pre[k].append(p[k])
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
        where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        yield Words(doc, np.searchsorted(where, inner), cat(hashes), {k: cat(v) for k, v in pre.items()})
        doc = last


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` word hashes (len(h) - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul = np.uint64(0xD6E8FEB86659FD93)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= mul
        acc += h[j:j + n]
    return mix(acc + np.uint64((k * 0x9E3779B1 + salt) & ((1 << 64) - 1)))
