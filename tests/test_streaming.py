"""Streaming ingest: availableNow over files equals the batch summary; replays are idempotent."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_stream_equals_batch(spark):
    q = entry.queries()
    streamed = sorted(q["stream_running_summary"](spark, SF).collect())
    batch = sorted(q["run_summary"](spark, SF).collect())
    assert streamed == batch


def test_duplicate_delivery_counted_once(spark, tmp_path):
    from evalgrid.streaming import attempts as sa

    rows = [
        '{"event_id": 1, "model_config_id": "m", "task_file": "f", "task_id": "t", "repeat_index": 0, "score": 1.0, "passed": true, "latency_sec": 0.5, "run_id": "r"}',
        '{"event_id": 2, "model_config_id": "m", "task_file": "f", "task_id": "t", "repeat_index": 1, "score": 0.0, "passed": false, "latency_sec": 0.25, "run_id": "r"}',
    ]
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.json").write_text("\n".join(rows) + "\n")
    (src / "b.json").write_text(rows[0] + "\n")  # re-delivered attempt
    qry = sa.start_running_summary(spark, str(src), str(tmp_path / "upd"), str(tmp_path / "ckpt"), max_files_per_trigger=1)
    qry.awaitTermination()
    s = sa.current_summary(spark, str(tmp_path / "upd")).collect()[0]
    assert (s.total_attempts, s.passed, s.average_score) == (2, 1, 0.5)
