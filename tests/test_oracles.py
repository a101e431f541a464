"""Every registered query that has SQL gives the rows that DuckDB gives."""

import pytest

from assayer.plans import registry

from .oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_agree(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
