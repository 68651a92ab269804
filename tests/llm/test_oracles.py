"""Corpus queries with SQL give the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from terrasift.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = con.sql(ORACLES[name])
    found = QUERIES[name](spark, str(DATA))
    assert sorted(found.columns) == sorted(wanted.columns)
    got = sorted(tuple(row[c] for c in wanted.columns) for row in found.collect())
    assert got == sorted(wanted.fetchall())
