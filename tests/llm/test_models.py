import numpy as np
from pyspark.sql import functions as F

from lakejoin.llm import language, toxicity

from llm_data import DOC

SF01 = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.filter(~held))
    rows = language.predict(docs.filter(held), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ppm_code_lengths():
    """Exact code lengths of a tiny tree."""
    counts = {"x": {(0 << 16) | (0 << 8) | 97: 1, (0 << 16) | (97 << 8) | 98: 1, (97 << 16) | (98 << 8) | 97: 1, (98 << 16) | (97 << 8) | 98: 1}}
    m = language.build(counts)
    import pyarrow as pa
    got = language.code_lengths(pa.array(["ab", "b", "aa"]), 1, m.row_of, m.bits)[:, 0]
    # order 2: context (0,0) saw 'a' once: 1/2; (0,a) saw 'b' once: 1/2
    assert abs(got[0] - 2.0) < 1e-5
    # 'b' after (0,0): escape 1/2; context (0) saw only 'a': escape 1/2; order 0: b 2 of 4, two kinds: 2/6
    assert abs(got[1] - (1 + 1 - np.log2(2 / 6))) < 1e-5
    # 'a' 1/2; 'a' after (0,a): escape 1/2; context (a) saw b twice: escape 1/3; order 0: a 2/6
    assert abs(got[2] - (1 + 1 - np.log2(1 / 3) - np.log2(2 / 6))) < 1e-5


def test_language_odd_rows(spark, odd, empty):
    model = language.fit(odd)
    out = language.predict(odd, model)
    rows = out.collect()
    assert out.columns == [*odd.columns, "lang_pred", "score_"] and len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (not (r["text"] or "").strip()) for r in rows)
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_long_text_in_pieces(monkeypatch):
    import pyarrow as pa
    m = language.build({"x": {97: 3, (97 << 8) | 98: 2}, "y": {98: 4}})
    col = pa.array(["ab" * 500, "", "b"])
    whole = language.code_lengths(col, 2, m.row_of, m.bits)
    monkeypatch.setattr(language, "CHUNK", 100)
    cut = language.code_lengths(col, 2, m.row_of, m.bits)
    assert np.allclose(whole[1:], cut[1:]) and np.allclose(whole[0], cut[0], rtol=0.05)


def test_every_language_and_row_counts(spark, monkeypatch):
    """70 languages with a letter of their own each: none is left out, however the blocks fall."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} common", f"l{i:02d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    want = language.predict(docs, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in want] == [r["lang"] for r in want]
    monkeypatch.setattr(language, "BLOCK", 1 << 19)
    monkeypatch.setattr(language, "RUN", 100)
    model = language.fit(docs)
    got = language.predict(docs, model).orderBy("doc_id").collect()
    assert len(model.blocks) > 10 and [r["lang_pred"] for r in got] == [r["lang_pred"] for r in want]
    assert np.allclose([r["score"] for r in got], [r["score"] for r in want])


def test_counts_are_passed_on_early(spark, monkeypatch):
    docs = spark.createDataFrame([(f"some words {i} of text", f"l{i % 3}") for i in range(60)], "text string, lang string").coalesce(1)
    want = sorted(map(tuple, language.count(docs).collect()))
    monkeypatch.setattr(language, "HELD", 20)
    assert sorted(map(tuple, language.count(docs).collect())) == want


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = toxicity.fit(docs, labels.filter(half), ["quality", "toxic"])
    rows = toxicity.score(docs.join(labels.filter(~half), "doc_id"), chain).collect()
    clean = [r["rejected"] for r in rows if not r["toxic"]]
    bad = [r["rejected"] for r in rows if r["toxic"]]
    assert np.mean(clean) < 0.02 and np.mean(bad) > 0.4


def test_later_models_see_out_of_fold_probabilities(spark):
    """The second category is the first one's opposite: the chain carries it over."""
    rows = [(i, ("good words here" if i % 2 else "other terms there") + f" u{i}") for i in range(200)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, first int, second int")
    chain = toxicity.fit(docs, lab, ["first", "second"])
    n = len(chain.vocab)
    assert len(chain.weights[0]) == n + 1 and len(chain.weights[1]) == n + 2
    assert chain.weights[1][n] < 0
    out = toxicity.score(docs, chain).collect()
    assert all((r["p_second"] > 0.5) == (r["doc_id"] % 2 == 0) for r in out)


def test_logistic_matches_its_optimum():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    y = np.array([1.0 if 0 in r and 3 not in r else float(rng.random() < 0.2) for r in rows])
    w = toxicity.fit_logistic(rows, np.zeros((300, 0)), y, 6, 0.5)
    x = np.zeros((300, 7))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, 6] = 1
    g = x.T @ (toxicity.sigmoid(x @ w) - y) + np.array([0.5] * 6 + [1e-6]) * w
    assert np.abs(g).max() < 1e-3


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (9, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd, labels, ["quality", "toxic"])
    out = toxicity.score(odd, chain)
    assert out.columns == [*odd.columns, "p_quality", "p_toxic", "rejected_"] and out.count() == odd.count()
    kept = toxicity.reject(odd, labels.limit(0), ["quality", "toxic"])
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.reject(empty, labels, ["quality", "toxic"]).count() == 0


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(i % 100, f"text {i} of words") for i in range(5000)] + [(0, "text 0 of words")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, ["toxic"], "doc_id", "text", 400).count()
    assert 250 < rows < 600
    assert toxicity._sample(docs, labels, ["toxic"], "doc_id", "text", 100_000).count() == 5000       # copies count once


def test_features_of_a_fold_are_chosen_without_its_labels(spark):
    """Feature 7 tells the label in fold 0 only; feature 9 in every other fold."""
    rows = [(fold, [y], [7] if fold == 0 and y else [9] if fold and y else [5]) for fold in range(4) for y in (0, 1) for _ in range(50)]
    sample = spark.createDataFrame(rows, "fold int, y array<int>, feats array<bigint>")
    got = {held: {int(x) for x in v} for held, v in toxicity._vocabulary(sample, 1).items()}
    assert 7 not in got[0] and 9 in got[0] and 7 in got[1] and {7, 9} <= got[-1]


def test_threshold_splits_the_probabilities_as_scoring_does(spark):
    docs = spark.createDataFrame([(i, ("bad thing" if i % 10 == 0 else "fine thing") + f" n{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels, ["toxic"])).collect()
    assert all(r["rejected"] == (r["doc_id"] % 10 == 0) for r in out)
