import importlib.util
import os


def test_entry_runs(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["table1", "table2", "column1", "column2", "prob", "rank"]
    assert set(mod.oracle_sql()) <= set(mod.queries())
