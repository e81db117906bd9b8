import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakejoin.llm import decontaminate as D

from llm_data import DATA

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return WORD.findall(low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        if w:
            m = min(13, len(w))
            for s in range(len(w) - m + 1):
                windows.setdefault(tuple(w[s:s + m]), set()).add("" if i is None else str(i))
    lens = sorted({len(k) for k in windows})
    out = []
    for i, t in docs:
        w = words_of(t)
        hit, ids = set(), set()
        for m in lens:
            for s in range(len(w) - m + 1):
                got = windows.get(tuple(w[s:s + m]))
                if got:
                    hit |= set(range(s, s + m))
                    ids |= got
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()]


key = lambda r: repr(r)


@pytest.mark.parametrize("filter_max", [1 << 20, 0])
def test_documents(spark, documents, filter_max):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = rows(D.contamination(documents, bench, filter_max=filter_max))
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[4] for r in got)


def test_random_spans(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "É", "x1", "the"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 12, 13, 14, 30])))) for i in range(25)] + [(None, "null id words here now"), (99, None)]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 60))
        if i % 2:
            src = rng.choice(items)[1] or ""
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = src.split()
        docs.append((i, rng.choice([" ", "-", ", "]).join(w).title()))
    docs += [(60, None), (61, ""), (62, "a " * 3000), (None, items[10][1])]
    got = rows(D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_removal(spark, documents, odd, empty):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    kept = D.remove_contaminated(documents, bench)
    assert kept.columns == documents.columns
    want = {r[0] for r in brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]) if not r[4]}
    assert {r["doc_id"] for r in kept.collect()} == want
    item = spark.createDataFrame([(1, "A b C, d")], "item_id long, text string")
    out = D.remove_contaminated(odd, item)
    assert out.columns == odd.columns
    assert out.count() == odd.count() - 2
    assert D.remove_contaminated(empty, bench).count() == 0
    assert D.remove_contaminated(odd, bench.limit(0)).count() == odd.count()
