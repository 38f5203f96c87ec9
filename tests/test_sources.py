"""Task files: line numbers across splits, error classification, fail-fast, configs."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from evalgrid.sources import configs as cfg
from evalgrid.sources import tasks as T


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


LINES = [
    '{"id": "a1", "description": "What is 2+2?", "expected_output": "4", "metadata": {"category": "math"}}',
    "",
    "   ",
    '{"id": 7, "description": "d", "expected_output": "x"}',
    "not json",
    '{"id": "x",}',
    "[1, 2]",
    '{"id": "b"}',
    '{"id": 1.5, "description": "d", "expected_output": "x"}',
    '{"id": "c", "description": 3, "expected_output": "x"}',
    '{"id": "", "description": "d", "expected_output": "x"}',
    '{"id": "d", "description": " ", "expected_output": "x"}',
    '{"id": "e", "description": "d", "expected_output": ""}',
    '{"id": true, "description": "d", "expected_output": "x", "extra": [1]}',
    '{"id": "f", "description": "d", "expected_output": "x"} trailing',
]

EXPECTED_ERRORS = {
    5: "Invalid JSON on line 5: Expecting value",
    6: "Invalid JSON on line 6: Illegal trailing comma before end of object",
    7: "Line 7: Expected JSON object, got list",
    8: "Line 8: Missing required fields: description, expected_output",
    9: "Line 9: 'id' must be a string or integer",
    10: "Line 10: 'description' must be a string",
    11: "Line 11: 'id' cannot be empty",
    13: "Line 13: 'expected_output' cannot be empty",
    15: "Invalid JSON on line 15: Extra data",
}


def test_parse_and_errors(spark):
    d = tempfile.mkdtemp(prefix="evalgrid-tasks-")
    _write(os.path.join(d, "tasks.jsonl"), LINES)
    tasks, errors = T.load_tasks(os.path.join(d, "tasks.jsonl"), spark=spark)
    got = {r.line_no: r.message for r in errors.collect()}
    assert got == EXPECTED_ERRORS
    ok = {r.line_no: (r.id, r.scorer) for r in tasks.collect()}
    assert ok == {1: ("a1", "numeric_close"), 4: ("7", "exact_match"), 12: ("d", "exact_match"), 14: ("True", "exact_match")}
    with pytest.raises(ValueError, match="Invalid JSON on line 5"):
        T.load_tasks(os.path.join(d, "tasks.jsonl"), spark=spark, mode="failfast")


def test_line_numbers_across_splits(spark):
    d = tempfile.mkdtemp(prefix="evalgrid-split-")
    lines = []
    for i in range(6000):
        lines.append("" if i % 37 == 0 else json.dumps({"id": f"t{i}", "description": "x" * (i % 50), "expected_output": "y"}))
    _write(os.path.join(d, "big.jsonl"), lines)
    _write(os.path.join(d, "small.jsonl"), lines[:10])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024))
    try:
        df = T.scan_lines(spark, d)
        assert df.rdd.getNumPartitions() >= 1
        got = {(os.path.basename(r.task_file), r.line_no): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("big.jsonl", i + 1): s for i, s in enumerate(lines)}
    want.update({("small.jsonl", i + 1): s for i, s in enumerate(lines[:10])})
    assert got == want


def test_missing_path(spark):
    with pytest.raises(FileNotFoundError):
        T.scan_lines(spark, "/nonexistent/evalgrid/tasks.jsonl")


def test_require_tasks_empty(spark):
    empty = spark.createDataFrame([], "task_file string, line_no long, line string")
    tasks, _ = T.parse_task_lines(empty)
    with pytest.raises(ValueError, match="No tasks found"):
        T.require_tasks(tasks)


def test_yaml_configs(spark):
    d = tempfile.mkdtemp(prefix="evalgrid-cfg-")
    _write(os.path.join(d, "a.yaml"), ["id: m1", "model_name: M", "runtime:", "  server_url: http://x", "settings:",
                                       "  temperature: 0.2", "  top_p: 0.9", "  max_tokens: 64"])
    _write(os.path.join(d, "b.yaml"), ["id: m2", "model_name: M", "runtime: {}", "settings: {}"])
    _write(os.path.join(d, "c.yaml"), ["- 1"])
    configs, errors = cfg.load_configs(cfg.read_config_texts(spark, d))
    ok = configs.collect()
    assert [(r.id, r.settings.temperature, r.settings.max_tokens) for r in ok] == [("m1", 0.2, 64)]
    msgs = sorted(r.message for r in errors.collect())
    assert msgs == ["Config file must contain a YAML mapping (dict), got list", "Missing required key 'server_url' in 'runtime'"]


def test_parse_error_detail(spark):
    lines = spark.createDataFrame([("f", 1, "not json"), ("f", 2, '{"id": "x",}'), ("f", 3, '{"a": 1} x')],
                                  "task_file string, line_no long, line string")
    _, errors = T.parse_task_lines(lines)
    got = sorted((r.line_no, r.message) for r in errors.collect())

    def msg(text):
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return e.msg

    assert got == [(1, f"Invalid JSON on line 1: {msg('not json')}"),
                   (2, "Invalid JSON on line 2: " + msg('{"id": "x",}')),
                   (3, "Invalid JSON on line 3: Extra data")]


def test_decode_calls_classification(spark):
    from evalgrid.sources.responses import decode_calls

    rows = [
        (1, "connection", None, None),
        (2, None, 503, "busy"),
        (3, None, 200, '{"choices": [{"message": {"content": "hi"}}]} trailing'),
        (4, None, 200, '{"choices": [], "id": "x"}'),
        (5, None, 200, '{"choices": [{"message": {"content": "hi"}}], "usage": {"total_tokens": 7}}'),
    ]
    log = spark.createDataFrame(rows, "k int, transport_error string, status_code int, body string")
    out = {r.k: r for r in decode_calls(log, server_url="http://h").collect()}
    assert out[1].error == "Could not connect to llama-server at http://h: connection"
    assert out[2].error == "llama-server returned HTTP 503: busy"
    assert out[3].error_kind == "non_json" and out[3].response is None
    assert out[4].error == "Response JSON missing expected field 'choices[0].message.content': available keys are ['choices', 'id']"
    assert out[5].error is None and out[5].response == "hi" and out[5].usage == {"total_tokens": 7}
