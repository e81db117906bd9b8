"""Plug-in encoder path and the hash encoder's determinism."""

import numpy as np
from pyspark.sql import functions as F

from lakejoin.operators.encode import encode_texts, hash_encode, to_dense


def test_plugin_encoder_runs_on_distinct_texts(spark):
    class CharCount:
        """Tiny deterministic encoder: letter counts a..z (defined locally so
        it ships to the Python workers by value)."""
        dim = 26

        def encode(self, texts):
            out = np.zeros((len(texts), 26), dtype=np.float32)
            for i, t in enumerate(texts):
                for ch in t.lower():
                    if "a" <= ch <= "z":
                        out[i, ord(ch) - 97] += 1
            return out

    df = spark.createDataFrame([("ab",), ("ab",), ("zz",)], "t string")
    got = {r.text: list(r.vec) for r in encode_texts(df, "t", CharCount()).collect()}
    assert set(got) == {"ab", "zz"}
    assert got["ab"][0] == 1.0 and got["ab"][1] == 1.0 and got["zz"][25] == 2.0


def test_hash_encoder_known_value(spark):
    # conv(substr(md5('abc'), 1, 8), 16, 10) = 2416005272 (same in DuckDB)
    df = spark.createDataFrame([(1, "abc abc")], "id long, text string")
    sp = hash_encode(df, ["id"], "text", dim=1000).collect()
    assert [(r.dim, abs(r.w)) for r in sp] == [(2416005272 % 1000, 2)]
    d = to_dense(hash_encode(df, ["id"], "text", dim=8), ["id"], 8).first().vec
    assert len(d) == 8 and sum(abs(x) for x in d) == 2.0
    _ = F


def test_rows_without_tokens_keep_their_place(spark):
    from lakejoin.operators.encode import packed_key_rows
    from lakejoin.operators.similarity import joinability_scores
    rows = [("q", 0, 0, "#", "red"), ("q", 1, 0, "#", "--"), ("q", 2, 0, "#", None), ("l", 0, 0, "#", "red")]
    k = spark.createDataFrame(rows, "table_id string, row_idx long, key_pos int, col_name string, value string")
    packed = packed_key_rows(k, 256)
    assert packed.count() == 4
    got = {(r.query_id, r.cand_id): (r.n_match, r.n_q) for r in joinability_scores(packed, packed, 0.7, packed_dim=256).collect()}
    assert got == {("q", "l"): (1, 3), ("l", "q"): (1, 1)}
