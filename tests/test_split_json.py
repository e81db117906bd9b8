"""Objects of large JSON files come out whole and in order, wherever the splits fall."""

import json
import random

import pytest

from lakejoin.sources.json_tables import read_table_documents, write_array
from lakejoin.sources.split_json import elements

ODD = ["", "}", "{", '"', "\\", '\\"', "}}{{", 'a"b}c', "é}", "\n", "[1,2", '"tables": [', "]"]


def table(rng, name):
    t = {"table_id": name, "columns": ["a", "b"],
         "cells": [[rng.choice(ODD) + str(rng.random()), rng.choice([None, 1, 1.5, True, rng.choice(ODD)])] for _ in range(rng.randrange(0, 12))]}
    return t | ({"meta": {"x": {"y": rng.choice(ODD)}}} if rng.random() < 0.3 else {})


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("wrapped, indent, ascii_", [(False, None, True), (True, None, True), (False, 2, False), (True, 1, False)])
def test_round_trip(spark, small_splits, tmp_path, wrapped, indent, ascii_):
    rng = random.Random(indent)
    tables = [table(rng, f"t{i}") for i in range(50)]
    obj = {"meta": {"n": [{"x": 1}]}, "tables": tables, "after": {"z": 1}, "more": [1, {}]} if wrapped else tables
    if wrapped:
        del obj["meta"], obj["more"]       # arrays of objects beside the tables are not told from them
    (tmp_path / "f.json").write_text(json.dumps(obj, indent=indent, ensure_ascii=ascii_))
    rows = sorted((r.block, r.n, r.value) for r in elements(spark, str(tmp_path / "f.json")).collect())
    assert [json.loads(v) for *_, v in rows] == tables
    assert len({b for b, *_ in rows}) > 10           # several tasks read the one file


def test_single_empty_and_bad_files(spark, small_splits, tmp_path):
    big = {"table_id": "one", "columns": ["a"], "cells": [["}" * 50] for _ in range(200)]}       # over many splits
    for name, text in (("one", json.dumps(big)), ("none", "[]"), ("cut", json.dumps([big])[:-700]), ("word", "hello")):
        (tmp_path / f"{name}.json").write_text(text)
    assert [json.loads(r.value) for r in elements(spark, str(tmp_path / "one.json")).collect()] == [big]
    assert elements(spark, str(tmp_path / "none.json")).count() == 0
    for bad in ("cut", "word"):
        with pytest.raises(Exception, match="unreadable table document"):
            read_table_documents(spark, str(tmp_path / f"{bad}.json")).cells.collect()


def test_array_writer(spark, small_splits, tmp_path):
    docs = [json.dumps({"table_id": f"t{i}", "columns": ["a"], "cells": [[str(i)]]}) for i in range(30)]
    df = spark.createDataFrame([(d,) for d in docs], "doc string").repartition(3)
    for wrapped in (False, True):
        path = str(tmp_path / f"out{wrapped}")
        write_array(df, path, wrapped=wrapped)
        lake = read_table_documents(spark, path)
        assert {(r.table_id, r.value) for r in lake.cells.collect()} == {(f"t{i}", str(i)) for i in range(30)}
    write_array(df.limit(0), str(tmp_path / "empty"))
    assert read_table_documents(spark, str(tmp_path / "empty")).tables.count() == 0


def test_text_is_looked_through_in_bounded_pieces(spark, tmp_path, monkeypatch):
    """A batch of many long pieces is scanned some bytes at once, with the same objects, and cut once for all readers."""
    import pyarrow as pa

    from lakejoin.sources import split_json
    part = pa.RecordBatch.from_pylist([{"value": "x" * 1000}] * 2000)
    texts = list(split_json._texts(part))
    assert b"".join(texts) == (b"x" * 1000 + b"}") * 2000 and len(texts) > 5 and max(map(len, texts)) <= split_json.SCAN_BYTES + 1001
    docs = [{"table_id": f"t{i}", "columns": ['a "}', "b\\"], "cells": [["}{[" * (i % 9), "\\\""], [None, "]"]]} for i in range(300)]
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    monkeypatch.setattr(split_json, "SCAN_BYTES", 100)
    found = split_json.elements(spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [json.loads(r.value) for r in found.orderBy("file", "block", "n").collect()] == docs
