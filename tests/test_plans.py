"""Persisted records are read where they are kept, also below unions."""

from kindred.operators import cells
from kindred.plans.fixture import Linkage


def test_records_are_not_made_anew(spark, small):
    x = Linkage(spark, small)
    x.records.count()
    for rows in (cells.counts(x.queries, x.pool), x.terms, x.rare):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.count("FileScan") <= plan.count("InMemoryTableScan")
