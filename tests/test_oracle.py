"""Every registered query against its SQL in DuckDB, on the given tables."""

from pathlib import Path

import pytest
from oracle import connect, spark_bag, sql_bag

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    columns, rows = spark_bag(registry.queries()[name](spark, SF))
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        expected_columns, expected = sql_bag(duck, sql)
        assert columns == expected_columns
        assert rows == expected


def test_entry(spark):
    assert registry.entry(spark).columns == ["book_id", "outcome", "n", "error"]
