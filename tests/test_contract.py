"""Every query with an SQL text gives the same rows as DuckDB; the others run."""

import glob
import math
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return repr(float(value))


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in rows)


def names():
    from vitagraph.plans.contract import QUERIES

    return list(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from vitagraph.plans.contract import ORACLES, QUERIES

    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        want = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
