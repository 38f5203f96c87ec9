"""Batch generation error isolation and data-quality helpers."""

from pyspark.sql import functions as F

from evalgrid.operators import generate as gen
from evalgrid.operators import plan as pl
from evalgrid.operators import quality as qa


def test_batch_generate_isolates_failures(spark):
    plan = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)], "k int, prompt string")
    out = {r.k: (r.response, r.error) for r in gen.batch_generate(plan, gen.echo_generator, keep=["k"], batch_size=4).collect()}
    assert out[1] == ("ANSWER: PROMPT 1", None)
    assert out[7][0] is None and out[7][1].startswith("generation failed")
    assert out[17][0] is None and out[6][1] is None


def test_expand_repeats_zero_and_negative(spark):
    t = spark.createDataFrame([("a",), ("b",)], "id string")
    assert pl.expand_repeats(t, 0).count() == 0
    assert pl.expand_repeats(t, -2).count() == 0
    assert sorted((r.id, r.repeat_index) for r in pl.expand_repeats(t, 2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_rules_and_transitions(spark):
    items = spark.createDataFrame(
        [("ok-1", "feature", 3, "pending", "2024-01-15T23:59:59Z", 1.25),
         ("bad id", "Feature", 9, "paused", "2024-02-30T00:00:00Z", 1.234)],
        "id string, type string, priority int, status string, due_date string, estimated_hours double",
    )
    v = sorted((r.id, r.rule) for r in qa.rule_violations(items).collect())
    assert v == [("bad id", r) for r in sorted(["id_format", "type_enum", "priority_range", "status_enum",
                                                  "due_date_format", "hours_precision"])]
    ev = spark.createDataFrame([("x", 1, "pending", "a"), ("x", 2, "in_progress", "b"), ("x", 3, "pending", "c"),
                                ("x", 4, "pending", "d"), ("x", 5, "cancelled", "e")], "e string, t int, status string, id string")
    bad = [(r.from_status, r.to_status) for r in qa.invalid_transitions(ev, "e", ["t"]).collect()]
    assert bad == [("in_progress", "pending")]
