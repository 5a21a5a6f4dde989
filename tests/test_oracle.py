"""Every registered query against its SQL in DuckDB, over the whole of the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from shop import TESTDATA

import __spark_entry__ as contract
from revlens.testbed import catalog, oracle

FOLDER = f"{TESTDATA}/{os.environ.get('ORACLE_SF', 'sf0.001')}"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
# the corpus queries have tests of their own
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry_returns_the_trend(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "year_month" and frame.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = duck.execute(SQL[name])
    kinds = {item[0]: str(item[1]) for item in cursor.description}
    assert sorted(kinds) == columns
    assert kinds == {f.name: KINDS[f.dataType.simpleString()] for f in frame.schema.fields}
    names = [item[0] for item in cursor.description]
    expected = [tuple(row[names.index(column)] for column in columns) for row in cursor.fetchall()]
    found = [tuple(row) for row in frame.select(*[f"`{column}`" for column in columns]).collect()]
    assert ordered(found) == ordered(expected)
