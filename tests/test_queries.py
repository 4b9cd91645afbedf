"""Every registered query of the core library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "inf" if x == float("inf") else f"{x:.9g}"
    return f"{x:.9g}" if isinstance(x, int) and abs(x) < 1 << 30 else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql(spark, name):
    rows = catalogue.QUERIES[name](spark, SMALL).collect()
    assert rows
    if name == "diff_round_trip":
        assert all(r["ok"] for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
