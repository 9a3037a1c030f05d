"""Physical-plan properties behind the scale claims (sf0.001 plans)."""

import pytest

from credo.plans.catalog import QUERIES
from tests.conftest import SF0001

FLOWS = {"train_model", "batch_score", "train_run", "evaluate_run", "predict_batch", "explain_batch", "score_stream"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FLOWS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF0001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_has_partial_group_limit(spark):
    plan = plan_of(QUERIES["top_words"](spark, SF0001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_perturbation_ranks_inside_the_row(spark):
    """Samples are drawn, scored and ranked in arrays: no row per sample, no shuffle by it, no ranking window."""
    plan = plan_of(QUERIES["perturbation_attribution"](spark, SF0001))
    assert "posexplode(slice(sort_array(" in plan
    assert "sample" not in plan and "WindowGroupLimit" not in plan and "row_number" not in plan


def test_dedup_pre_aggregates_before_shuffle(spark):
    plan = plan_of(QUERIES["deduplicate"](spark, SF0001))
    # a partial aggregate feeds the first shuffle; no window sees raw rows by statement
    assert "partial_min" in plan
