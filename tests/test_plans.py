"""Plan shape: scoring stays JVM-side, summaries aggregate map-side, small sides broadcast."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_scoring_has_no_python_udf(spark):
    plan = _plan(entry.queries()["score_all"](spark, SF))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_summary_is_partial_then_final_aggregation(spark):
    plan = _plan(entry.queries()["run_summary"](spark, SF))
    assert plan.count("HashAggregate") >= 4  # partial + final, per task then per run
    assert "Window" not in plan


def test_small_task_side_is_broadcast_by_spark(spark):
    plan = _plan(entry.queries()["evaluate_task_files"](spark, SF))
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_latest_run_is_an_aggregate_not_a_window(spark):
    plan = _plan(entry.queries()["leaderboard_latest"](spark, SF))
    assert "max_by" in plan and "Window" not in plan
