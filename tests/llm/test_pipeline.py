import importlib
import os
import subprocess
import sys

import corpus_pipeline as P
from lakejoin.llm import shared

from llm_data import DATA

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_one_by_one(spark, documents):
    from test_decontaminate import brute as contaminated
    from test_jaccard import brute as similar
    from test_line_dedup import brute as lines
    docs = documents
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = shared.staged(stage(spark, docs, DATA))
        if name != "bpe":
            assert out.columns == documents.columns and out.schema == documents.schema, name
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert 0 < len(before) - len(after) and not any(labels.get(i) == 0 for i in before if i not in after)
        elif name == "line_dedup":
            assert after == lines(list(before.items()))
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in similar(list(before.items())).items() if i == c}
        elif name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in contaminated(list(before.items()), bench) if not r[4]}
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
        docs = out


def test_odd_rows_pass_every_stage(spark, odd, empty):
    for name, stage in P.STAGES:
        got = stage(spark, odd, DATA)
        assert got.count() <= odd.count()
        if name != "bpe":
            assert got.columns == odd.columns
        assert stage(spark, empty, DATA).count() == 0


def test_nothing_else_imports_the_package():
    code = ("import sys; sys.modules['lakejoin.llm'] = None; import __spark_entry__ as e; "
            "assert not any(q.startswith('op') and '_' in q and q[2].isdigit() for q in e.queries()); assert 'pipeline' not in e.queries()")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]


def test_each_operator_is_registered():
    import __spark_entry__ as e
    names = [q for q in e.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in e.queries()
