"""Sinks: raw JSONL, summary CSV, Markdown report, per-sink failure isolation."""

import glob
import os

from evalgrid.operators import leaderboard as lb
from evalgrid.operators import summary as sm
from evalgrid.sinks import files as sinks


def _attempts(spark):
    rows = [("r1", "m", "tasks/a.jsonl", "t1", "ok", 1.0, True, 0.5, None),
            ("r1", "m", "tasks/a.jsonl", "t2", "", 0.0, False, 0.0, "boom")]
    return spark.createDataFrame(rows, "run_id string, model_config_id string, task_file string, task_id string, "
                                       "response string, score double, passed boolean, latency_sec double, reason string")


def test_round_trips(spark, tmp_path):
    a = _attempts(spark)
    sinks.write_raw_attempts(a, str(tmp_path / "raw"))
    back = spark.read.json(str(tmp_path / "raw"))
    assert back.count() == 2 and set(back.columns) >= {"model_config_id", "run_id", "reason"}
    assert os.path.isdir(tmp_path / "raw" / "model_config_id=m" / "run_id=r1")
    s = sm.run_summary(a)
    sinks.write_summary(sm.format_summary(s), str(tmp_path / "summary"))
    parsed = lb.parse_summary_text(sinks.read_summary_csv(spark, str(tmp_path / "summary"))).collect()[0]
    assert (parsed.total_attempts, parsed.passed, parsed.pass_rate) == (2, 1, 0.5)
    sinks.write_leaderboard(lb.leaderboard(lb.parse_summary_text(sinks.read_summary_csv(spark, str(tmp_path / "summary")))),
                            str(tmp_path / "md"))
    text = open(glob.glob(str(tmp_path / "md" / "part-*"))[0]).read().splitlines()
    assert text[0] == lb.TITLE and text[4] == "| m | tasks/a.jsonl | 2 | 2 | 1 | 50.0% | 0.50 | 0.25s |"


def test_empty_report_and_failure_isolation(spark, tmp_path):
    empty = spark.createDataFrame([], ",".join(f"{c} string" for c in sm.SUMMARY_COLUMNS))
    sinks.write_leaderboard(lb.leaderboard(lb.parse_summary_text(empty)), str(tmp_path / "empty"))
    text = open(glob.glob(str(tmp_path / "empty" / "part-*"))[0]).read()
    assert text == f"{lb.TITLE}\n\n{lb.EMPTY}\n"
    root = tmp_path / "run"
    root.mkdir()
    (root / "raw").write_text("a file where a directory should be")
    a = _attempts(spark)
    s = sm.run_summary(a)
    status = sinks.persist_run(a, s, lb.leaderboard(s), str(root))
    assert status["raw"].startswith("error") and status["summary"] == "ok" and status["leaderboard"] == "ok"


def test_same_run_id_keeps_first_row(spark, tmp_path):
    p = tmp_path / "s.csv"
    header = ",".join(sm.SUMMARY_COLUMNS)
    p.write_text(header + "\n" + "r1,m,f,2,2,2,0,1.0000,1.0000,0.500,1\n" + "r1,m,f,2,2,0,2,0.0000,0.0000,0.500,1\n")
    board = lb.leaderboard(lb.parse_summary_text(sinks.read_summary_csv(spark, str(p)))).collect()
    assert [(r.pass_rate, r.average_score) for r in board] == [(1.0, 1.0)]
