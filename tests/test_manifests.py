"""Manifests from event logs, damaged documents, scorers by suite, long histories."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from evalgrid.operators import manifests as mf
from evalgrid.operators import quality as qa
from evalgrid.operators import runs as rn
from evalgrid.operators.sequence import row_number_within, with_quantile_bucket

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run_id string, model_config_id string, task_file string, ts timestamp, event_id int, status string, model_name string, total_tasks bigint"


def _events(spark, rows):
    full = [("r", "m", "f", None if h is None else T0 + dt.timedelta(hours=h), i, *rest) for i, (h, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_last_known_value_of_each_field(spark):
    ev = _events(spark, [(3, "completed", None, None), (0, "running", "M", 5), (4, None, None, 7), (2, "paused", "N", None), (None, "failed", "Z", 9)])
    r = mf.run_manifests(ev).collect()[0]
    assert (r.status, r.model_name, r.total_tasks, r.suite_id) == ("completed", "N", 7, None)
    assert (r.started_at, r.completed_at, r.last_event_at) == tuple(T0 + dt.timedelta(hours=h) for h in (0, 3, 4))


def test_partials_merge_in_any_order_and_twice(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50), rnd.choice([None, "running", "failed", "odd"]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2])) for _ in range(400)]
    ev = _events(spark, rows)
    whole = mf.manifest_partials(ev)
    parts = [mf.manifest_partials(ev.filter(F.col("event_id") % 3 == i)) for i in (2, 0, 1, 0)]
    merged = mf.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    assert merged.collect() == whole.select(*merged.columns).collect()


def test_silent_and_unknown_runs(spark):
    as_of = T0 + dt.timedelta(hours=10)
    for rows, want in (([(0, "running", None, None)], ("running", True)), ([(0, "running", None, None), (9.5, None, "M", None)], ("running", False)),
                       ([(0, "failed", None, None)], ("failed", False)), ([(0, None, "M", None)], ("unknown", False))):
        r = mf.run_manifests(_events(spark, rows), as_of=as_of).collect()[0]
        assert (r.status, r.silent) == want
    assert mf.run_manifests(_events(spark, [])).count() == 0


def test_damaged_documents_keep_their_run(spark):
    whole = json.dumps({"status": "completed", "repeats": 2, "settings": {"top_p": 1}, "suite_id": 3, "task_file": "t", "completed_at": None})
    docs = [("results/runs/m/r1/manifest.json", whole), ("s3://b/x/m/r2/manifest.json", whole[:20]), ("m/r3/manifest.json", None),
            ("m/r4/manifest.json", "[]"), ("m/r5/manifest.json", '{"status": "odd", "repeats": "x"}'), ("manifest.json", "{}")]
    got = {r.path: r for r in mf.read_manifests(spark.createDataFrame(docs, "path string, text string")).collect()}
    first = got[docs[0][0]]
    assert (first.model_config_id, first.run_id, first.status, first.repeats, first.settings, first.suite_id) == ("m", "r1", "completed", 2, '{"top_p":1}', None)
    assert [(got[p].run_id, got[p].corrupt, got[p].status) for p, _ in docs[1:]] == [
        ("r2", True, "unknown"), ("r3", True, "unknown"), ("r4", True, "unknown"), ("r5", False, "unknown"), ("", False, "unknown")]


def test_two_suites_score_a_file_differently(spark):
    rows = spark.createDataFrame([("f", "math", "exact_match"), ("f", "code", "json_valid"), ("g", None, "exact_match"), ("h", "math", "numeric_close")],
                                 "task_file string, spec_category string, spec_scorer string")
    suites = spark.createDataFrame([("a", "f", "plain"), ("b", "f", "strict"), ("c", "g", "strict"), ("c", "g", "strict")], "suite_id string, task_file string, scoring string")
    rules = spark.createDataFrame([("strict", "math", "numeric_close"), ("strict", "math", "zzz"), ("strict", None, "keyword_match")], "scoring string, category string, scorer string")
    got = {(r.suite_id, r.task_file, r.spec_category): r.spec_scorer for r in rn.with_suite_scorers(rows, suites, rules).collect()}
    assert got == {("a", "f", "math"): "exact_match", ("a", "f", "code"): "json_valid", ("b", "f", "math"): "numeric_close",
                   ("b", "f", "code"): "keyword_match", ("c", "g", None): "keyword_match", (None, "h", "math"): "numeric_close"}


def test_long_history_in_many_tasks_equals_the_window(spark):
    rnd = random.Random(5)
    states = ["pending", "in_progress", "blocked", "completed"]
    # half of all rows on one entity, some without one, some without a time
    rows = [(0 if i % 2 else rnd.choice([None, 1, 2, 3]), None if i % 50 == 0 else rnd.randrange(2000), i, rnd.choice([*states, None])) for i in range(4000)]
    ev = spark.createDataFrame(rows, "e int, t int, id int, status string")
    cut = qa.invalid_transitions(ev, "e", ["t", "id"], long_history=300)
    whole = qa.invalid_transitions(ev, "e", ["t", "id"], long_history=None)
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0 and whole.count() > 1000
    stretches = with_quantile_bucket(ev, ["e"], "t", "b", long_group=300).groupBy("e").agg(F.count_distinct("b").alias("n"), F.max("b").alias("top")).collect()
    assert {r.e: r.n for r in stretches}[0] > 100
    sizes = with_quantile_bucket(ev, ["e"], "t", "b", long_group=300).filter("e = 0").groupBy("b").count().agg(F.max("count")).first()[0]
    assert sizes < 100
    assert with_quantile_bucket(ev, ["e"], "t", "b", long_group=10_000).filter("b <> 0").count() == 0
    marked = with_quantile_bucket(ev, ["e"], "t", "b", long_group=300)
    numbered = row_number_within(marked, ["e"], ["t", "id"], out="rn", bucket=F.col("b")).select("id", "rn")
    assert sorted(numbered.collect()) == sorted(row_number_within(ev, ["e"], ["t", "id"], out="rn").select("id", "rn").collect())
