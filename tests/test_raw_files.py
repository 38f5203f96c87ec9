"""Result files by exact names, and the index of what is whole in them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalgrid.sinks import rawfiles as rf

SCHEMA = "model_config_id string, task_file string, run_id string, task_id string, repeat_index int, response string, score double"


def _attempts(spark, n=40):
    rows = [("m é", f"data/tasks/{'a' if i % 3 else 'b'}.jsonl", "2024_r", f"t{i:03d}", 0, None if i % 5 == 0 else f"é {i}", float(i)) for i in range(n)]
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)


def test_names_order_nulls_and_empty_runs(spark, tmp_path):
    root = str(tmp_path / "results" / "raw")
    planned = spark.createDataFrame([("m é", "data/tasks/a.jsonl", "2024_r"), ("other", "x/empty.jsonl", "r9")], "model_config_id string, task_file string, run_id string")
    rf.write_raw_files(_attempts(spark), root, runs=planned)
    got = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))
    assert got == ["m é/a_2024_r.jsonl", "m é/b_2024_r.jsonl", "other/empty_r9.jsonl"]
    lines = [json.loads(x) for x in open(f"{root}/m é/b_2024_r.jsonl", encoding="utf-8")]
    assert [x["task_id"] for x in lines] == [f"t{i:03d}" for i in range(0, 40, 3)] and lines[0]["response"] is None and lines[1]["response"] == "é 3"
    assert os.path.getsize(f"{root}/other/empty_r9.jsonl") == 0
    rf.write_raw_files(_attempts(spark, 6), root)  # the same names again: replaced, others stay
    assert len(open(f"{root}/m é/b_2024_r.jsonl").readlines()) == 2 and os.path.exists(f"{root}/other/empty_r9.jsonl")


def test_long_runs_go_on_in_further_files(spark, tmp_path):
    root = str(tmp_path / "raw")
    rf.write_raw_files(_attempts(spark, 300), root, rows_per_file=50)
    files = sorted(os.listdir(f"{root}/m é"))
    assert "a_2024_r.jsonl" in files and "a_2024_r.4.jsonl" in files
    ids = [json.loads(x)["task_id"] for f in files if f.endswith(".jsonl") for x in open(f"{root}/m é/{f}")]
    assert sorted(ids) == [f"t{i:03d}" for i in range(300)]


def test_names_that_leave_the_root_are_refused(spark, tmp_path):
    bad = _attempts(spark, 3).withColumn("model_config_id", F.lit("../../up"))
    with pytest.raises(ValueError):
        rf.write_raw_files(bad, str(tmp_path / "raw"))
    assert not os.path.exists(tmp_path / "up")
    rf.write_raw_files(_attempts(spark, 3).limit(0), str(tmp_path / "none"))
    assert [f for _, _, fs in os.walk(tmp_path / "none") for f in fs] == []


def test_torn_files_by_offset(spark, tmp_path):
    root = tmp_path / "raw"
    rf.write_raw_files(_attempts(spark), str(root))
    whole = (root / "m é" / "a_2024_r.jsonl").read_bytes()
    lines = whole.splitlines(keepends=True)
    (root / "m é" / "a_2024_r.jsonl").unlink()
    cases = {"cut": b"".join(lines[:5]) + lines[5][:-4], "character": lines[0] + lines[1][: lines[1].index("é".encode()) + 1], "whole": whole,
             "open end": whole[:-1], "inside": lines[0] + b"{]\r\n" + b"\n" + lines[1], "junk": b"\xff\xfe", "empty": b""}
    for name, data in cases.items():
        (root / "m é" / f"{name}.jsonl").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")  # lines of a file in many splits
    try:
        index = rf.raw_line_index(spark, str(root)).collect()
        report = {r.file: r for r in rf.raw_file_report(rf.raw_line_index(spark, str(root))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, data in cases.items():
        mine = sorted((r for r in index if r.file == f"m é/{name}.jsonl"), key=lambda r: r.line_no)
        want, at = [], 0
        for raw in data.split(b"\n") if data and not data.endswith(b"\n") else data.split(b"\n")[:-1]:
            want.append((at, len(raw), min(at + len(raw) + 1, len(data))))
            at += len(raw) + 1
        assert [(r.byte_offset, r.byte_length, r.end_offset) for r in mine] == want, name
        assert [r.line_no for r in mine] == list(range(1, len(want) + 1))
        for r in mine:
            try:
                good = isinstance(json.loads(data[r.byte_offset : r.byte_offset + r.byte_length]), dict)
            except ValueError:
                good = False
            assert r.ok == good, (name, r)
    r = report["m é/cut.jsonl"]
    assert (r.lines, r.corrupt_lines, r.good_bytes, r.torn) == (6, 1, sum(map(len, lines[:5])), True)
    assert (report["m é/inside.jsonl"].corrupt_lines, report["m é/inside.jsonl"].torn, report["m é/junk.jsonl"].good_bytes) == (2, False, 0)
    assert not report["m é/whole.jsonl"].torn and not report["m é/open end.jsonl"].torn and "m é/empty.jsonl" not in report
