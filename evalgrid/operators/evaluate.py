"""Score logged responses against parsed tasks.

The scoring spec is computed once per task (``parse_task_lines`` adds the
``spec_*`` columns on the tasks table), not once per attempt. Tasks are
joined to responses on the task key without a hint: Spark broadcasts tasks
while their bytes are under its threshold, and adaptive execution splits the
responses of a popular task beyond it. A response whose task is unknown, or
whose call failed, becomes an error attempt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.operators.scorers import score_frame

UNKNOWN_TASK = "Unknown task"


def evaluate_responses(
    responses: DataFrame,
    tasks: DataFrame,
    keys: Sequence[str] = ("task_file", "id"),
    response: str = "response",
) -> DataFrame:
    """Responses (plus optional ``error``) scored with their task's spec.

    Adds ``scorer``, ``score``, ``passed``, ``reason``. Rows with an
    ``error`` (failed call) or without a matching task are error attempts:
    score 0.0, not passed, the error text as reason, empty response and
    latency 0.0 (so failed calls count as zero latency in averages).

    Every response gives one row. Ids may repeat within a task file: responses
    that carry ``line_no`` can be keyed with it (``keys=("task_file",
    "line_no")``); others meet the first line with their id.
    """
    spec_cols = [c for c in tasks.columns if c.startswith("spec_")]
    first = F.col("line_no") if "line_no" in tasks.columns else F.lit(0)
    t = tasks.groupBy(*keys).agg(F.min_by(F.struct(*spec_cols), first).alias("task_"))
    t = t.select(*keys, "task_.*", F.lit(True).alias("task_matched_"))
    j = responses.join(t, list(keys), "left")
    scored = score_frame(j, response=response, spec="spec")
    err = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    failure = F.when(F.col("task_matched_").isNull(), F.lit(UNKNOWN_TASK)).otherwise(err)
    passthrough = []
    for c in responses.columns:
        if c == "latency_sec":
            passthrough.append(F.when(failure.isNotNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c))
        elif c == response:
            passthrough.append(F.when(failure.isNotNull(), F.lit("")).otherwise(F.col(c)).alias(c))
        else:
            passthrough.append(F.col(c))
    out = scored.select(
        *passthrough,
        F.col("spec_scorer").alias("scorer"),
        F.when(failure.isNotNull(), F.lit(0.0)).otherwise(F.col("result.score")).alias("score"),
        F.when(failure.isNotNull(), F.lit(False)).otherwise(F.col("result.passed")).alias("passed"),
        F.coalesce(failure, F.col("result.reason")).alias("reason"),
    )
    return out
