"""Registered queries against DuckDB on the smallest tables, and the entry point."""

import os

import duckdb
import pytest

from brickwise.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def rows(columns, found):
    """Rows in the order of their names, floats to nine digits, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = catalog.queries()[name](spark, sf_dir)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
