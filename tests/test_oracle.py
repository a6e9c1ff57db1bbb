"""Every registered query with SQL gives what DuckDB gives."""

import pytest
from compare import duck_rows, spark_rows

from keelspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    if name not in SQL:
        assert df.columns
        return
    assert spark_rows(df) == duck_rows(duck.sql(SQL[name]))


def test_every_query_has_sql():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) - set(SQL) == set()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
