"""Every corpus query against its SQL in DuckDB, and the CRC-32 that the SQL computes."""

import os
import zlib

import duckdb
import pytest
from emendata.llm import common, queries

from tests.test_catalog import plain


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark, data, sql):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    result = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want)


def test_crc32_in_sql(sql):
    for text in ("", "0", "12", "a:é", "straße", "x" * 50):
        assert sql.execute(f"SELECT {common.crc32_sql('s')} FROM (SELECT ? AS s)", [text]).fetchone()[0] == zlib.crc32(text.encode())
