"""Every registered query against its DuckDB oracle (rows, columns, values) on sf0.001."""

import pytest

from litfeed.plans.catalogue import REGISTRY
from litfeed.plans.verify import compare

SF_SMALL = "/root/testdata/sf0.001"


WITH_SQL = sorted(n for n, e in REGISTRY.items() if e.sql is not None)
ROWS_ONLY = sorted(n for n, e in REGISTRY.items() if e.sql is None)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, {name}, verbose=False)
    assert res[name][0] == "ok", res[name]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    assert df.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
