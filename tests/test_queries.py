"""Every registered query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from docloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(repr([round(float(x), 6) if isinstance(x, float) else x for x in r]) for r in rows)


def test_all_have_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = tables.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
