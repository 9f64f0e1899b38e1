import pytest

from ripplet.plans import registry
from tests.compare import duck_rows, spark_rows

SQL = registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_each_query_has_sql():
    assert registry.queries().keys() == SQL.keys()


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    names, kinds, want = duck_rows(SQL[name], sf)
    got_names, got = spark_rows(df)
    assert got_names == names
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    assert len(got) == len(want) and got == want
