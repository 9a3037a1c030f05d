"""Every SQL-backed query against its DuckDB oracle, on the smallest tables."""

import pytest

from credo.plans.catalog import ORACLE, QUERIES
from credo.plans.oracle_check import compare, duckdb_conn
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def con():
    return duckdb_conn(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF0001), ORACLE[name], SF0001, con)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["row_key", "split", "y", "cs", "unseen"]
    assert df.count() == 3505
    assert set(e.oracle_sql()) <= set(e.queries())
