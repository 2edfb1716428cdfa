"""Every linkage query against its SQL in a second engine, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kindred.plans.files import FILE_QUERIES
from kindred.plans.oracles import ORACLES
from kindred.plans.queries import QUERIES as LINKAGE_QUERIES

QUERIES = LINKAGE_QUERIES | FILE_QUERIES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(tuple(canon(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall())
    else:
        assert rows
    spark.catalog.clearCache()


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
