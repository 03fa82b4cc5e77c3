"""Every registered query against its SQL counterpart, row for row."""

import pytest

from casebook import compare, oracle
from casebook.queries import queries

QUERIES = queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return compare.connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf, connection):
    assert compare.differences(QUERIES[name](spark, sf), connection, SQL[name]) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
