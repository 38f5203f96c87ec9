"""Broadcast bound fallback, ordinals vs window, CRLF task files, first-n tasks."""

import contextlib
import io
import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalgrid.operators import attempts as at
from evalgrid.operators import plan as pl
from evalgrid.sources import tasks as T


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_attempt_ordinals_match_window(spark):
    rows = [("r" if i % 3 else "hot", f"t{i % 7}", i % 4, i) for i in range(400)]
    df = spark.createDataFrame(rows, "run_id string, task_id string, repeat_index int, uid int")
    got = pl.attempt_ordinals(df, ["run_id"], ["task_id", "repeat_index", "uid"]).select("uid", "ordinal", "total")
    w = Window.partitionBy("run_id").orderBy("task_id", "repeat_index", "uid")
    want = df.select("uid", F.row_number().over(w).alias("ordinal"), F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("total"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_crlf_lines_and_first_n(spark):
    d = tempfile.mkdtemp(prefix="evalgrid-crlf-")
    lines = [f'{{"id": "t{i}", "description": "d", "expected_output": "x"}}' for i in range(6)]
    with open(os.path.join(d, "a.jsonl"), "w", newline="") as fh:
        fh.write("\r\n".join(lines[:3]) + "\r\n\r\n" + "\n".join(lines[3:]) + "\n")
    tasks, errors = T.load_tasks(d, spark=spark)
    assert errors.count() == 0
    got = sorted((r.line_no, r.id) for r in tasks.collect())
    assert got == [(1, "t0"), (2, "t1"), (3, "t2"), (5, "t3"), (6, "t4"), (7, "t5")]
    first = sorted(r.id for r in pl.first_n_tasks(tasks.select("task_file", "line_no", "id"), 4).collect())
    assert first == ["t0", "t1", "t2", "t3"]


def test_evaluate_responses_error_rows(spark):
    from evalgrid.operators.evaluate import evaluate_responses

    lines = spark.createDataFrame([("f", 1, '{"id": "a", "description": "d", "expected_output": "x"}')],
                                  "task_file string, line_no long, line string")
    tasks, _ = T.parse_task_lines(lines)
    resp = spark.createDataFrame([("f", "a", "X", 0.5, None), ("f", "a", None, 120.0, "timeout"), ("f", "zz", "x", 0.3, None)],
                                 "task_file string, id string, response string, latency_sec double, error string")
    out = sorted((r.id, r.response, r.latency_sec, r.passed, r.reason) for r in evaluate_responses(resp, tasks).collect())
    assert out == [("a", "", 0.0, False, "timeout"), ("a", "X", 0.5, True, "Matched expected answer"),
                   ("zz", "", 0.0, False, "Unknown task")]
