"""Every query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(row):
    return tuple(round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    got = sorted(map(repr, map(_plain, df.select(*cols).collect())))
    assert got == sorted(map(repr, map(_plain, want.select(*cols).fetchall())))
    assert got


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).columns == ["transcript_id", "n", "cue"]
