"""Every registered query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# minutes of rounds each: compared on larger tables outside the tests, their parts in test_differential.py
SLOW = {"differential_taxa", "pseudo_sensitivity", "differential_days"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert {c: KINDS[k] for c, k in df.dtypes} == {c[0]: str(c[1]) for c in result.description}
    mine, theirs = ordered([tuple(r) for r in df.collect()], df.columns), ordered(result.fetchall(), columns)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "species", "guild", "mean"]
    shares = {}
    for r in df.collect():
        shares[r.time, r.species] = shares.get((r.time, r.species), 0) + r["mean"]
    assert shares and all(abs(v - 1) < 1e-5 for v in shares.values())


def test_no_twin_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
