"""Every query against its SQL in DuckDB, and that every query has rows of a stable schema."""

import os

import duckdb
import pytest
from emendata.plans import catalog


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return connection


def plain(rows):
    shaped = [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows]
    return sorted(shaped, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(name, spark, data, sql):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    result = sql.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(name, spark, data):
    assert not catalog.QUERIES[name](spark, data).isEmpty()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
