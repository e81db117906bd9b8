from pyspark.sql import functions as F

from lakejoin.llm import line_dedup


def brute(docs):
    """docs: list of (id, text); the definition, read literally."""
    first = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            if "".join(w).strip(" "):
                first.setdefault(w, (i, p))
    out = {}
    for i, t in docs:
        ls, gone = t.split("\n"), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            if w in first and first[w] != (i, p):
                fi, fp = first[w]
                gone |= set(range(max(p, fp + 3) if fi == i else p, p + 3))
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_against_the_definition(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "r\nr\nr\nr\nr\nr"), (4, "\n\n\n\n"), (5, "a\nb"), (6, "b\nc\nd\nb\nc\nd"),
            (7, "r\nr\nr"), (8, "a\nb\nc\nd")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute(docs)
    assert got[1] == "a\nb\nc\nd" and got[2] == "x\ny" and got[3] == "r\nr\nr" and got[8] == ""


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents).collect()}
    assert got == brute(rows)


def test_passage_over_fifty_words(spark):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(9)) for i in range(6))
    df = spark.createDataFrame([(i, f"own {i}\n{passage}\nend {i}") for i in range(30)], "doc_id long, text string")
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == f"own 0\n{passage}\nend 0"
    assert all(got[i] == f"own {i}\nend {i}" for i in range(1, 30))


def test_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd, counts=True)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert out.columns[:len(odd.columns)] == odd.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    assert line_dedup.dedup_lines(empty).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 2 + [(2, "a\nb\nc")], "doc_id long, text string")
    got = sorted((r[0], r[1]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_many_lines_in_one_text(spark):
    """Alternating kept and removed spans; a quadratic cut would take minutes."""
    import random
    import time
    rng = random.Random(3)
    first = [f"a{i}" for i in range(60_000)]
    second = []
    for i in range(0, 60_000, 4):
        second += first[i:i + 3] + ([f"own{i}"] if rng.random() < 0.9 else [])
    docs = [(1, "\n".join(first)), (2, "\n".join(second)), (3, "\n".join(second[:100]))]
    start = time.time()
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and time.time() - start < 60
