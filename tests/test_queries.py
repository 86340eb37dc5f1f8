"""Every query of the chain against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from strikeline.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "supplier"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or value != value:
        return "~"
    return repr(float(value) + 0.0) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in mine.collect())
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
