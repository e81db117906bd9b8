"""Edge fixtures of the loaders (FIXTURES.md section 3)."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakejoin.sources.csv_tables import read_csv_tables, read_links
from lakejoin.sources.json_tables import inline_truth, read_table_documents, read_truth


def write(path, obj):
    path.write_text(json.dumps(obj) if not isinstance(obj, str) else obj)
    return str(path)


def cells_of(lake):
    return sorted((r.table_id, r.row_idx, r.col_idx, r.col_name, r.value) for r in lake.cells.collect())


def test_row_major_padding_and_last_wins(spark, tmp_path):
    docs = [{"table_id": "t1", "columns": ["a", "b"], "cells": [["1", "x"], ["2"], [], ["3", None]],
             "join_key_indices": [1, 5, 0]},
            {"table_id": "t2-top", "columns": ["c"], "cells": [["9"]]},
            {"table_id": "t1", "columns": ["z"], "cells": [["last"]]}]
    p = write(tmp_path / "docs.json", docs)
    lake = read_table_documents(spark, p, "row_major", "last")
    assert cells_of(lake) == [("t1", 0, 0, "z", "last"), ("t2-top", 0, 0, "c", "9")]
    lake = read_table_documents(spark, p, "row_major", "first")
    c = cells_of(lake)
    # A: short and empty rows padded with NULL
    assert ("t1", 1, 1, "b", None) in c and ("t1", 0, 1, "b", "x") in c
    assert [x for x in c if x[0] == "t1" and x[1] == 2] == [("t1", 2, 0, "a", None), ("t1", 2, 1, "b", None)]
    # B: raw rows; the empty row has no cells, the short row only its present cell
    c = cells_of(read_table_documents(spark, p, "row_major", "first", pad_short_rows=False))
    assert [x for x in c if x[0] == "t1" and x[1] in (1, 2)] == [("t1", 1, 0, "a", "2")]
    keys = sorted((r.col_name, r.key_pos) for r in lake.columns.where("table_id = 't1'").collect())
    assert keys == [("a", 1), ("b", 0)]
    t = {r.table_id: (r.base_id, r.partition) for r in lake.tables.collect()}
    assert t["t2-top"] == ("t2", "top")


def test_wrapped_and_single_and_numbers(spark, tmp_path):
    p = write(tmp_path / "w.json", '{"tables": [{"table_id": "a", "columns": ["n"], "cells": [[1.50], [2]]}]}')
    lake = read_table_documents(spark, p, "row_major", "none")
    assert [r.value for r in lake.cells.orderBy("row_idx").collect()] == ["1.5", "2"]
    p2 = write(tmp_path / "s.json", {"table_id": "b", "columns": ["n"], "cells": [["v"]]})
    assert cells_of(read_table_documents(spark, p2, "row_major", "none")) == [("b", 0, 0, "n", "v")]


def test_column_major_and_rows_compaction(spark, tmp_path):
    p = write(tmp_path / "cm.json", [{"table_id": "a", "columns": ["x", "y"], "cells": [["1", "2"], ["3"]]}])
    assert cells_of(read_table_documents(spark, p, "column_major", "none")) == [
        ("a", 0, 0, "x", "1"), ("a", 0, 1, "y", "3"), ("a", 1, 0, "x", "2")]
    p = write(tmp_path / "rows.json", [{"table_id": "a", "columns": ["x", "y"], "rows": [["1"], ["2", "3"], ["4", "5", "6"]]}])
    # short rows compact the column: y gets rows 0 and 1 (from source rows 1 and 2)
    assert cells_of(read_table_documents(spark, p, "rows", "none")) == [
        ("a", 0, 0, "x", "1"), ("a", 0, 1, "y", "3"), ("a", 1, 0, "x", "2"), ("a", 1, 1, "y", "5"), ("a", 2, 0, "x", "4")]


def test_truth_map_and_list(spark, tmp_path):
    p = write(tmp_path / "gt.json", '{"q1": ["a", "b"], "q2": "bad", "": ["x"], "q3": [], "q4": [1, 2]}')
    truth, q = read_truth(spark, p)
    assert sorted(tuple(r) for r in truth.collect()) == [("q1", "a", 0), ("q1", "b", 1), ("q4", "1", 0), ("q4", "2", 1)]
    assert sorted(r.query_id for r in q.collect()) == ["q1", "q3", "q4"]
    p = write(tmp_path / "gl.json", [{"query_id": "q1", "positives": ["a"]}, {"query_id": "q1", "positives": ["b", "c"]}])
    truth, q = read_truth(spark, p)
    assert sorted(tuple(r) for r in truth.collect()) == [("q1", "b", 0), ("q1", "c", 1)]


def test_inline_truth_fallback(spark, tmp_path):
    docs = write(tmp_path / "q.json", [{"table_id": "q1", "columns": ["a"], "cells": [], "ground_truth": ["x"]},
                                       {"table_id": "q2", "columns": ["a"], "cells": [], "ground_truth": ["y"]}])
    gt = write(tmp_path / "gt.json", {"q1": []})
    truth, q = read_truth(spark, gt)
    t2, q2 = inline_truth(spark, docs, truth, q)
    assert sorted(tuple(r) for r in t2.collect()) == [("q2", "y", 0)]
    assert sorted(r.query_id for r in q2.collect()) == ["q1", "q2"]


def test_csv_flat_folder_and_links(spark, tmp_path):
    d = tmp_path / "flat"
    d.mkdir()
    (d / "t1.csv").write_text(" id ,name\n1,a\n,b\n3,\n")
    (d / "t2.csv").write_text("k\nNA\nx\n")
    (d / "bad.csv").write_text('"a,b\n"1\n')
    lake, rejects = read_csv_tables(spark, str(d), "flat")
    c = cells_of(lake)
    assert ("t1", 0, 0, "id", "1.0") in c and ("t1", 1, 0, "id", None) in c and ("t1", 2, 1, "name", None) in c
    assert ("t2", 0, 0, "k", None) in c and ("t2", 1, 0, "k", "x") in c
    assert {r.table_id for r in rejects.collect()} <= {"bad"}
    f = tmp_path / "fold"
    (f / "f1").mkdir(parents=True)
    (f / "f1" / "t.csv").write_text(" a \n1\n")
    lake2, _ = read_csv_tables(spark, str(f), "folder")
    assert cells_of(lake2) == [("f1/t", 0, 0, " a ", "1")]
    links = tmp_path / "links.csv"
    links.write_text("t1.csv, t2 ,id,k\nt1,t2,missing,k\nt1,zz,id,k\nt1\\x,t2,id,k\n")
    got = [tuple(r) for r in read_links(spark, str(links), lake).select("table1", "column1", "table2", "column2").collect()]
    assert got == [("t1", "id", "t2", "k")]


def test_csv_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver is not given a pattern down to the files; files beside or below the folders are no tables."""
    root = tmp_path / "many"
    for i in range(50):
        (root / f"f{i}").mkdir(parents=True)
        (root / f"f{i}" / "t.csv").write_text(f"a,a\n{i},\n")
    (root / "f0" / "k=1").mkdir()
    for odd in (root / "beside.csv", root / "f0" / "k=1" / "below.csv", root / "f0" / "t.txt"):
        odd.write_text("x\n1\n")
    (root / "f1" / "none.csv").write_text("only,names\n")
    reader = type(spark.read)
    load, asked = reader.load, []

    def loaded(self, path=None, *args, **kw):
        asked.append(path)
        return load(self, path, *args, **kw)

    monkeypatch.setattr(reader, "load", loaded)
    for at in (str(root), f"file://{root}/", f"{tmp_path}/./x/../many"):
        lake, rejects = read_csv_tables(spark, at, "folder")
        want = [(f"f{i}/t", 0, c, name, v) for i in range(50) for c, name, v in ((0, "a", str(i)), (1, "a.1", None))]
        assert sorted(cells_of(lake), key=repr) == sorted(want, key=repr)
        assert lake.columns.filter("table_id = 'f1/none'").count() == 2 and rejects.count() == 0
    assert asked and not any(p.endswith("/*/*.csv") for p in asked)


def test_csv_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file a table: small tables are not all written by one task."""
    from lakejoin.plans.registry import QUERIES
    import lakejoin.plans.queries_catalog as Q
    rows = [(i, t, r, f"text {i}, \"{t}\"") for i in range(64) for t, r in ((0, "user"), (1, "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = str(tmp_path / "written")
    monkeypatch.setattr(Q, "scratch", lambda *_: out)
    got = {(r.table_id, r.row_idx, r.col_idx): r.value for r in QUERIES["load_csv_folder"](spark, str(tmp_path)).collect()}
    assert got == {(f"conv_{i}", t, c): (role, text)[c] for i, t, role, text in rows for c in (0, 1)}
    files = [f.name for f in Path(out).glob("*/*.csv")]
    assert len(files) == 64 and len({f.split("-")[1] for f in files}) > 4


def test_explicit_base_and_partition_win(spark, tmp_path):
    p = write(tmp_path / "b.json", [{"table_id": "x-top-1", "columns": ["a"], "cells": [["1"]], "base_id": "B",
                                     "partition": ""},
                                    {"table_id": "y_z", "columns": ["a"], "cells": [["1"]], "partition": "p9"}])
    t = {r.table_id: (r.base_id, r.partition) for r in read_table_documents(spark, p).tables.collect()}
    assert t == {"x-top-1": ("B", "top"), "y_z": ("y", "p9")}


def test_unreadable_documents_fail_or_are_listed(spark, tmp_path):
    from pyspark.errors import PySparkException
    from lakejoin.sources.json_tables import documents_from_text, json_rejects
    good, cut, shape = '[{"table_id": "a", "columns": ["x"], "cells": [["1"]]}]', '[{"table_id": "b", "colu', '{"foo": 1}'
    raw = spark.createDataFrame([("good", good), ("cut", cut), ("shape", shape)], "file string, value string")
    assert sorted(r.file for r in json_rejects(raw).collect()) == ["cut", "shape"]
    assert [r.doc.table_id for r in documents_from_text(raw, "skip").collect()] == ["a"]
    with pytest.raises(PySparkException, match="unreadable table document"):
        documents_from_text(raw).collect()
