import pytest

from lakejoin.llm.queries import QUERIES, SQL
from lakejoin.plans.compare import duck, rows_of

from llm_data import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(DATA).execute(SQL[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
