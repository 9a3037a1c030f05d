"""Queries with SQL against DuckDB, on the smallest tables."""

import pytest

from credo.llm.queries import ORACLE, QUERIES
from credo.plans.oracle_check import compare
from tests.conftest import SF0001


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SF0001), ORACLE[name], SF0001)
    assert ok, message
