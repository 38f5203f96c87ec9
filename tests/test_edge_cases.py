"""Cases that whole-table queries over the given data do not reach."""

import math

import pytest
from pyspark.sql import functions as F

from evalgrid.operators import attempts as at
from evalgrid.operators import leaderboard as lb
from evalgrid.operators.evaluate import evaluate_responses
from evalgrid.operators.scorers import score_tasks
from evalgrid.operators.summary import SUMMARY_COLUMNS, run_summary
from evalgrid.sinks import files
from evalgrid.sources import responses as rsp


def scored(spark, name, task, response):
    df = spark.createDataFrame([(task, response)], "t string, response string").withColumn("task", F.expr("parse_json(t)"))
    r = score_tasks(df, scorer=name).first().result
    return r.score, r.passed


@pytest.mark.parametrize(
    "name,task,response,want",
    [
        ("exact_match", '{"expected": [1, 2]}', "[1, 2]", (1.0, True)),
        ("exact_match", '{"expected": {"a": [null, true, "x"]}}', "{'a': [None, True, 'x']}", (1.0, True)),
        ("keyword_match", '{"expected_keywords": ["a", null]}', "a none", (1.0, True)),
        ("json_valid", '{"expected_tool": 9007199254740993}', '{"tool": 9007199254740992}', (0.5, False)),
        ("json_valid", '{"expected_tool": 9007199254740993}', '{"tool": 9007199254740993}', (1.0, True)),
    ],
)
def test_scores(spark, name, task, response, want):
    assert scored(spark, name, task, response) == want


def test_averages_keep_nan_infinity_and_thirds(spark):
    rows = [("a", "t1", True, 1 / 3, math.nan), ("a", "t2", False, 1 / 3, 2.0), ("b", "t1", True, 1e-12, math.inf), ("b", "t1", True, 1e13 + 0.5, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, task_id string, passed boolean, score double, latency_sec double")
    df = df.withColumns({"model_config_id": F.lit("m"), "task_file": F.lit("f")})
    got = {r.run_id: r for r in run_summary(df).collect()}
    assert got["a"].average_score == 1 / 3 and math.isnan(got["a"].average_latency_sec)
    assert got["b"].average_latency_sec == math.inf and got["b"].average_score == (1e13 + 0.5 + 1e-12) / 2


def test_average_does_not_depend_on_order(spark):
    values = [math.sin(i) * 10 ** (i % 9 - 4) for i in range(2000)]
    df = spark.createDataFrame([("r", "m", "f", str(i), True, v, v) for i, v in enumerate(values)],
                               "run_id string, model_config_id string, task_file string, task_id string, passed boolean, score double, latency_sec double")
    means = {run_summary(df.repartition(n, "score")).first().average_score for n in (1, 3, 8)}
    assert means == {math.fsum(values) / len(values)}


def test_null_settings_are_sent(spark):
    df = spark.createDataFrame([("p",)], "prompt string").withColumn(
        "settings", F.expr("named_struct('temperature', CAST(NULL AS DOUBLE), 'top_p', 0.5D, 'max_tokens', 3)"))
    assert df.select(at.request_payload()).first()[0].endswith('"temperature":null,"top_p":0.5,"max_tokens":3}')


def test_keys_of_a_body_and_usage(spark):
    log = spark.createDataFrame(
        [(None, 200, '{"object": 1, "id": 2}', 0.00051), (None, 200, '{"choices": [{"message": {"content": "hi"}}], "usage": {"a": 1.5, "b": {"c": 2}}}', 1.0)],
        "transport_error string, status_code int, body string, latency_sec double")
    a, b = rsp.decode_calls(log, "u").collect()
    assert a.error.endswith("available keys are ['object', 'id']") and a.latency_sec == 0.001
    assert float(b.usage["a"]) == 1.5 and b.usage_json == '{"a":1.5,"b":{"c":2}}'


def test_repeated_task_ids_keep_one_row_a_response(spark):
    from evalgrid.sources.tasks import parse_task_lines

    lines = spark.createDataFrame(
        [("f", 1, '{"id": "x", "description": "d", "expected_output": "one"}'), ("f", 2, '{"id": "x", "description": "d", "expected_output": "two"}')],
        "task_file string, line_no long, line string")
    tasks, _ = parse_task_lines(lines)
    responses = spark.createDataFrame([("f", "x", 1, "one", 0.1), ("f", "x", 2, "two", 0.1)], "task_file string, id string, line_no long, response string, latency_sec double")
    by_id = evaluate_responses(responses.drop("line_no"), tasks).orderBy("response").collect()
    by_line = evaluate_responses(responses, tasks, keys=("task_file", "line_no")).collect()
    assert [r.passed for r in by_id] == [True, False] and all(r.passed for r in by_line) and len(by_line) == 2


def test_first_of_equal_runs_by_file_then_line_also_after_migration(spark, tmp_path):
    row = {c: "1" for c in SUMMARY_COLUMNS} | {"run_id": "r", "model_config_id": "m", "task_file": "f"}
    for name, scores in (("b", ["0.9"]), ("a", ["0.1", "0.5"])):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"{name}.csv").write_text(
            "\n".join([",".join(SUMMARY_COLUMNS), *(",".join((row | {"average_score": s})[c] for c in SUMMARY_COLUMNS) for s in scores)]) + "\n")
    rows = files.read_summary_csv(spark, str(tmp_path / "s"))
    assert lb.leaderboard(lb.parse_summary_text(rows)).first().average_score == 0.1
    again = lb.migrate_summary_frames([rows, rows])
    assert lb.leaderboard(lb.parse_summary_text(again)).first().average_score == 0.1


def test_missing_summary_gives_the_empty_report(spark, tmp_path):
    rows = files.read_summary_csv(spark, str(tmp_path / "nothing"))
    board = lb.leaderboard(lb.parse_summary_text(rows))
    assert lb.markdown_text(board) == f"{lb.TITLE}\n\n{lb.EMPTY}\n"


def test_a_sink_that_fails_without_text_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise ValueError

    monkeypatch.setattr(files, "write_raw_attempts", broken)
    rows = files.read_summary_csv(spark, str(tmp_path / "nothing"))
    summary = lb.parse_summary_text(rows)
    status = files.persist_run(rows, summary, lb.leaderboard(summary), str(tmp_path / "out"))
    assert status == {"raw": "error: ValueError: ", "summary": "ok", "leaderboard": "ok"}


def test_cluster_sessions_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from evalgrid import session

    spark = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda **_: pytest.fail("a local folder was made"))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(spark)
    spark.sparkContext.getCheckpointDir = lambda: "s3a://bucket/ckpt/"
    assert session.scratch_path(spark, "a") == "s3a://bucket/ckpt/evalgrid/a"


def test_names_modes_and_limits_of_task_files(spark, tmp_path, monkeypatch):
    from evalgrid.sources.tasks import load_tasks, scan_lines

    (tmp_path / "data" / "tasks").mkdir(parents=True)
    (tmp_path / "data" / "tasks" / "x.jsonl").write_text('{"id": "a", "description": "d", "expected_output": "e"}\n{"id": "b"}\nnot json\n')
    path = f"{tmp_path}/data/tasks/*.jsonl"
    assert {r.task_file for r in scan_lines(spark, path, naming="as_given").collect()} == {f"{tmp_path}/data/tasks/x.jsonl"}
    assert {r.task_file for r in scan_lines(spark, path, naming="stem").collect()} == {"x"}
    tasks, errors = load_tasks(path, spark)
    assert (tasks.count(), [r.line_no for r in errors.orderBy("line_no").collect()]) == (1, [2, 3])
    tasks, errors = load_tasks(path, spark, validate=False)
    assert (tasks.count(), [r.line_no for r in errors.collect()]) == (2, [3])
    tasks, errors = load_tasks(path, spark, max_lines=1)
    assert (tasks.count(), errors.count()) == (1, 0)


def test_digits_of_other_scripts(spark):
    from evalgrid.functions.text import first_number, py_float

    texts = ["٣٫٥ or ٣.٥", "१२", "x7", "𝟗", "１_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(first_number("t")).collect()] == ["3", "12", "7", "9", "1"]
    assert [r[0] for r in df.select(py_float("t")).collect()] == [None, 12.0, None, 9.0, 10.0]


def test_settings_by_row_in_generation(spark):
    from evalgrid.operators.generate import batch_generate

    df = spark.range(10).selectExpr("id", "concat('p', id) AS prompt", "named_struct('temperature', id % 2) AS settings").coalesce(1)
    out = batch_generate(df, lambda prompts, s: [f"{p}@{s['temperature']}x{len(prompts)}" for p in prompts], settings="settings", batch_size=3, keep=["id"])
    got = {r.id: r.response for r in out.collect()}
    assert {i: v.split("x")[0] for i, v in got.items()} == {i: f"p{i}@{i % 2}" for i in range(10)}
    assert all(int(v.split("x")[1]) <= 3 for v in got.values())


def test_runs_suites_artifacts_and_references(spark):
    from evalgrid.operators import quality as qa
    from evalgrid.operators import runs as rn

    events = spark.createDataFrame([("a", "running", 1), ("a", "completed", 2), ("b", "running", 3)], "run_id string, status string, ts int")
    assert {r.run_id: r.finished_at for r in rn.latest_status(events, ["run_id"]).collect()} == {"a": 2, "b": None}
    summary = spark.createDataFrame([("a",), ("c",)], "run_id string")
    assert {r.run_id: r.status for r in rn.runs_overview(summary, rn.latest_status(events, ["run_id"]), ["run_id"]).collect()} == {
        "a": "completed", "b": "running", "c": "unknown"}
    suites = spark.createDataFrame([("s", "f")], "suite_id string, task_file string")
    assert rn.require_suites(["s"], suites).count() == 1
    with pytest.raises(ValueError, match="Unknown suite id: t"):
        rn.require_suites(["s", "t"], suites)
    attempts = spark.createDataFrame([("code", "s", "x y", None), ("code", "s", "z", "py"), ("code", "s", "w", ".rs"), ("math", "s", "q", None)],
                                     "category string, suite string, id string, artifact_extension string")
    assert sorted(r.artifact_path for r in rn.artifact_rows(attempts, "suite", "id").collect()) == [
        "artifacts/s/w_response.rs", "artifacts/s/x_y_response.md", "artifacts/s/z_response.py"]
    items = spark.createDataFrame([("1", ["2", "9"], None), ("2", [], "8"), ("3", None, "1")], "id string, dependencies array<string>, parent_id string")
    assert [(r.id, r.dependencies) for r in qa.dangling_references(items, "dependencies").collect()] == [("1", "9")]
    assert [r.id for r in qa.dangling_references(items, "parent_id").collect()] == ["2"]


def test_rules_of_optional_fields(spark):
    from evalgrid.operators.quality import further_rules, rule_violations

    good = ("a", "d", None, None, ["x-1"], [], {"k": "v"}, 1.25, "2024-02-29T00:00:00Z")
    bad = ("b", "d\n" + "x" * 10_000, "t" * 201, "s" * 101, ["x y", None] + ["t"] * 19, ["d"] * 51,
           {str(i): "" for i in range(50)} | {"long": "v" * 10_001}, math.inf, "2023-02-30T00:00:00Z")
    worse = ("c", None, None, None, None, None, None, 0.125, "2024-01-01")
    df = spark.createDataFrame([good, bad, worse], "id string, description string, title string, source string, tags array<string>, "
                               "dependencies array<string>, metadata map<string,string>, actual_hours double, created_at string")
    got = {}
    for r in rule_violations(df, rules=further_rules(df.columns)).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {
        "b": {"description_length", "description_newline", "title_length", "source_length", "tags_count", "tags_format",
              "dependencies_count", "metadata_count", "metadata_length", "actual_hours_finite", "created_at_format"},
        "c": {"actual_hours_precision", "created_at_format"},
    }
