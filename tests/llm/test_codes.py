import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejoin.llm import codes


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    by = sorted((i, v) for i, _, v in kept if i is not None)
    dim = len(by[0][1])
    m = dim // parts
    cut = lambda v: [v[p * m:(p + 1) * m] for p in range(parts)]
    start = [v for _, v in by if len(v) == dim][:entries]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    fit = [(i, lab, cut(v)) for i, lab, v in kept if len(v) == dim]
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [near(v[p], p)[1] for *_, v in fit]
            new.append([[sum(c) // len(c) for c in zip(*g)] if (g := [v[p] for (*_, v), k in zip(fit, of) if k == e]) else books[p][e] for e in range(len(start))])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, lab, "".join(f"{near(v[p], p)[1]:02x}" for p in range(parts)), sum(near(v[p], p)[0] for p in range(parts))) for i, lab, v in fit]
    out += [(i, lab, None, None) for i, lab, v in kept if len(v) != dim]
    per = {}
    for _, lab, _, e in out:
        if e is not None:
            per[lab] = per.get(lab, 0) + e
    return sorted((repr(i), c, e, per.get(lab), digest) for i, lab, c, e in out)


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("v", F.lit(1))
    return sorted((repr(r["vec_id"]), *list(r)[1:]) for r in codes.compress(df.repartition(3), **kw).collect())


@pytest.mark.parametrize("cells", [8, 1, 200])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(codes, "CELLS", cells)
    rng = np.random.default_rng(cells)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 6) / 2], [None, 1, 2][i % 3]) for i in rng.permutation(180)]
    kw = dict(parts=3, entries=12, rounds=2, scale=4)
    assert result(spark, rows, **kw) == brute(rows, **kw)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None, 1), (2, [1.0, 2.0, 3.0, 4.0], None), (3, [nan] * 4, 1), (4, [None] * 4, 1), (5, [1.0], 2), (2, [1.0, 2.0, 3.0, 4.0], None),
            (None, [5.0, 5.0, 5.0, 1e5], 1), (6, [], 1), (7, [-0.1, 0.0, 0.1, float("-inf")], 1)]
    kw = dict(parts=2, entries=4, rounds=2, scale=256)
    got = result(spark, rows, **kw)
    assert got == sorted(brute(rows, **kw), key=lambda r: (r[0], r[1] or ""))
    assert result(spark, [], **kw) == []
    with pytest.raises(ValueError):
        result(spark, [(1, [1.0, 2.0, 3.0], 1)], **kw)


def test_cells_are_exact_and_prune(monkeypatch):
    monkeypatch.setattr(codes, "MAX_CELLS", 50)
    rng = np.random.default_rng(0)
    e = rng.integers(-60, 60, (64, 4))
    e[40] = e[3]                                           # equal entries: the lower index wins
    grid = codes.Grid(e)
    x = rng.integers(-90, 90, (3000, 4))
    for part in (x[:1000], x[1000:]):
        code, dist = grid.nearest(part)
        d = ((part[:, None, :] - e[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert grid.measured < 0.6 * 64 * 3000
