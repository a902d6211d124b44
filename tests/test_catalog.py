"""Every registered query against its SQL, on the smallest of the given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from wattframe.catalog import ORACLE, QUERIES
from tools.compare import TABLES, by_name, differences

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def database(testdata):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{testdata}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(NAMES) == set(ORACLE)
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark, testdata):
    # Two places with two measures each.
    assert entry.entry(spark).count() == 4


def test_differences_are_found():
    rows = [("a", 1.0, None), ("b", 2.0, 3)]
    assert differences(rows, [("b", 2.000001, 3), ("a", 1.0, None)]) == []
    for other in ([("a", 1.0, None)], [("a", 1.1, None), ("b", 2.0, 3)], [("a", 1.0, 0.0), ("b", 2.0, 3)]):
        assert differences(rows, other)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, testdata, database, name):
    df = entry.queries()[name](spark, testdata)
    columns, mine = by_name(df.columns, df.collect())
    found = database.execute(entry.oracle_sql()[name])
    names, theirs = by_name([d[0] for d in found.description], found.fetchall())
    assert columns == names
    assert differences(mine, theirs) == []
