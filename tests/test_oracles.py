"""Every query with an oracle against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from depthlane.plans import catalogue


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return -1e99
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool_" else round(float(v), 6) + 0.0

    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(name, spark, db, sf_dir):
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalogue.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert len(ours)
    assert rows(ours, columns) == rows(theirs, columns)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLES.keys()))
def test_kernel_queries_run(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
