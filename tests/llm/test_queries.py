"""The registered queries themselves over the small tables, against SQL and brute force written here."""

import glob
import os

import duckdb
import pytest

from depthlane.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, db, sf_dir):
    ours, theirs = queries.QUERIES[name](spark, sf_dir), db.execute(queries.ORACLES[name])
    columns = sorted(ours.columns)
    names = [d[0] for d in theirs.description]
    assert columns == sorted(names)
    assert sorted(tuple(r[c] for c in columns) for r in ours.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in theirs.fetchall())
