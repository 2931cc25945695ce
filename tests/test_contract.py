"""Every registered query against its SQL counterpart, on the smallest tables."""

import os

import pytest

import compare
import workload
from tabulark.session import prepare

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = workload.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, connection, name):
    df = QUERIES[name](prepare(spark), FOLDER)
    if name in SQL:
        assert compare.differences(df, connection, SQL[name]) == []
    else:
        assert df.columns


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["o_custkey", "n_orders", "total_cents"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
