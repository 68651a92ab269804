"""Every query with SQL gives the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from terrasift.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    wanted = sql.sql(ORACLES[name])
    names = wanted.columns
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in wanted.fetchall()), key=repr)
