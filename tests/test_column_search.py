"""The bounded column search equals brute force, meets fewer pairs, and parts of hot dimensions change nothing."""

import random

import pytest

from lakejoin.operators import similarity as S

EMB = "table_id string, col_name string, dim int, w long"


def embeddings(seed, tables=40, words=400):
    """Columns share the frequent dimensions 0 and 1; copies of columns give ties."""
    rng = random.Random(seed)
    pool, out = [], {}
    for t in range(tables):
        for c in range(rng.randrange(1, 4)):
            if pool and rng.random() < 0.5:
                v = dict(rng.choice(pool))
                if rng.random() < 0.7:
                    v[rng.randrange(2, words)] = rng.choice([-2, 1, 3])
            else:
                v = {0: 1, 1: 2, **{rng.randrange(2, words): rng.choice([-1, 1, 2, 4]) for _ in range(6)}}
            pool.append(v)
            out[f"t{t:02d}", f"c{c}"] = v
    return out


def frame(spark, emb):
    return spark.createDataFrame([(t, c, d, w) for (t, c), v in emb.items() for d, w in v.items()], EMB)


def brute(emb, k, exclude_self=False):
    norm = {i: sum(w * w for w in v.values()) ** 0.5 + 1e-8 for i, v in emb.items()}
    out = []
    for q in sorted({t for t, _ in emb}):
        cols = sorted(i for i in emb if i[0] == q)
        scored = []
        for l in sorted({t for t, _ in emb}):
            if l == q and exclude_self:
                continue
            s = 0.0
            for a in cols:
                s += max(0.0, *(sum(w * emb[b].get(d, 0) for d, w in emb[a].items()) / (norm[a] * norm[b]) for b in emb if b[0] == l))
            if s / len(cols) > 0:
                scored.append((-(s / len(cols)), l))
        out += [(q, l, round(-s, 12), r + 1) for r, (s, l) in enumerate(sorted((round(s, 12), l) for s, l in scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, exclude_self", [(1, False), (3, True), (10, False), (100, False)])
def test_equals_brute_force(spark, k, exclude_self):
    emb = embeddings(k)
    df = frame(spark, emb)
    keys = spark.createDataFrame(list(emb), "table_id string, col_name string")
    found = S.ColumnSearch(df, df, keys, k, exclude_self)
    got = found.top().collect()
    want = brute(emb, k, exclude_self)
    by = lambda rows: {(q, r): s for q, _, s, r in rows}
    assert by((r.query_id, r.cand_id, round(r.score, 12), r.rank) for r in got) == by(want)
    # the same tables, but for scores that differ in the last bits only
    sure = {(q, l) for q, l, s, _ in want if sum(x[2] == s and x[0] == q for x in brute(emb, 100, exclude_self)) == 1}
    assert sure <= {(r.query_id, r.cand_id) for r in got}
    work = found.work().first()
    if k <= 3:
        assert work.pairs_met < 0.6 * work.pairs_all and work.tables_scored < 0.55 * 40 * 40
    if k == 100:
        assert work.pairs_met == work.pairs_all


def test_parts_of_hot_dimensions(spark, monkeypatch):
    emb = embeddings(7)
    df = frame(spark, emb)
    ids = ["table_id", "col_name"]
    whole = {tuple(r) for r in S.sparse_cosine(df, df, ids, ids).collect()}
    monkeypatch.setattr(S, "HOT_LIST", 3)
    assert {tuple(r) for r in S.sparse_cosine(df, df, ids, ids).collect()} == whole


def test_empty_sides(spark):
    df = frame(spark, embeddings(1, tables=3))
    keys = df.select("table_id", "col_name").distinct()
    assert S.table_search_columns(df, df.limit(0), keys, 3).count() == 0
    assert S.table_search_columns(df.limit(0), df, keys.limit(0), 3).count() == 0


@pytest.mark.parametrize("k, exclude_self", [(1, False), (3, True), (100, False)])
def test_blocks_equal_the_bounded_search(spark, monkeypatch, k, exclude_self):
    """Several blocks and tiles, equal columns, ties: the same rows, scores to the last bit."""
    monkeypatch.setattr(S, "TILE_ROWS", 4)
    emb = embeddings(k + 20)
    df, keys = frame(spark, emb), spark.createDataFrame(list(emb), "table_id string, col_name string")
    want = sorted(map(tuple, S.table_search_columns(df, df, keys, k, exclude_self, path="sparse").collect()))
    for blocks in ((None, None), (3, 2)):
        assert sorted(map(tuple, S.table_search_columns_blocks(df, df, keys, k, exclude_self, *blocks).collect())) == want


def test_columns_that_share_most_words_go_by_blocks(spark, monkeypatch):
    """Each pair shares most dimensions: the join would meet every pair on each of them."""
    def never(*_):
        raise AssertionError("the join was taken")
    rows = [(f"t{t:02d}", "c", d, 1 + (t * d) % 3) for t in range(30) for d in range(20)]
    df = spark.createDataFrame(rows, EMB)
    keys = df.select("table_id", "col_name").distinct()
    want = sorted(map(tuple, S.table_search_columns(df, df, keys, 5, path="sparse").collect()))
    monkeypatch.setattr(S, "ColumnSearch", never)
    assert sorted(map(tuple, S.table_search_columns(df, df, keys, 5).collect())) == want
