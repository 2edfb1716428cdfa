"""The queries that SQL can express, against a second engine over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from kindred.llm.oracles import ORACLES
from kindred.llm.queries import QUERIES
from kindred.llm.secret_scan import BASE_KINDS


def canon(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, small)
    columns, want = sorted(df.columns), c.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(canon(r[x]) for x in columns) for r in df.collect())
    assert rows == sorted(tuple(canon(dict(zip(want.columns, r))[x]) for x in columns) for r in want.fetchall())


def test_the_tables_hold_no_checksummed_key(spark):
    """Else the SQL of the secret scan, which says the base kinds alone, would be short."""
    kinds = QUERIES["op1_secret_scan"](spark, "/root/testdata/sf0.01").selectExpr("explode(filter(split(spans, ','), x -> x <> '')) s").selectExpr("split(s, ':')[0] k").distinct().collect()
    assert {r.k for r in kinds} <= set(BASE_KINDS)
