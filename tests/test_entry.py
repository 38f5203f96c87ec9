"""Driver contract: entry() runs, every query has a callable, oracles agree on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["model_config_id", "task_file", "total_tasks", "total_attempts", "repeats",
                          "pass_rate", "average_score", "average_latency_sec"]


def test_oracles_cover_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


FAST = ["score_all", "run_summary", "leaderboard_markdown", "task_errors", "scan_tasks", "decode_responses",
        "rule_violations", "invalid_transitions", "import_qa_tasks", "run_summary_full"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_oracle_agreement_small(spark):
    from oracle_check import compare

    rep = compare(spark, SF, FAST)
    bad = {k: v for k, v in rep.items() if v["status"] not in ("match", "match~")}
    assert not bad, bad
