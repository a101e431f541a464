"""Every query of the subpackage that has SQL gives the rows that DuckDB gives."""

import pytest

from assayer.llm import queries
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_agree(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(connect(SF), queries.oracle_sql()[name])
