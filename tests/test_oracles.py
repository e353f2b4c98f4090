"""Every query with SQL gives the rows that DuckDB gives."""

import decimal

import duckdb
import pytest

from drawlens.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return ("number", round(float(v), 5))
    return (type(v).__name__, str(v))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted(names) == columns
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (x[0] == y[0] == "number" and abs(x[1] - y[1]) < 2e-5), (a, b)
