"""Every registered query, in one session, in registry order (as the driver
runs them): each returns a DataFrame whose rows can be produced."""

import pytest

from tests.conftest import SF0001


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as e

    return e.queries()


def test_all_queries_run_in_one_session(spark, registry):
    failed = {}
    for name, fn in registry.items():
        try:
            fn(spark, SF0001).count()
        except Exception as exc:  # report all failures at once
            failed[name] = str(exc).split("\n")[0][:200]
    assert not failed, failed
