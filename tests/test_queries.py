"""Registered queries against DuckDB over small tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = want.fetchall()
    order = sorted(columns)
    ours = sorted(repr(tuple(r[c] for c in order)) for r in found.collect())
    assert ours == sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
