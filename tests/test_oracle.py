"""Every query that SQL can express, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tally.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert ours == theirs


def test_all_have_sql():
    assert set(queries()) == set(oracle_sql())
