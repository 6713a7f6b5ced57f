import pytest

from rankweave.plans import catalogue
from tests.compare import connected, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(data):
    return connected(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, con, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, data))
    sql_names, expected = sql_rows(con, catalogue.ORACLE_SQL[name])
    assert names == sql_names
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
