"""Run summaries: one row per (run_id, model_config_id, task_file).

Two hash aggregations, each with map-side partial aggregation: first per
task (attempt count, passes, exact sums), then per run. A hot run or task
is collapsed to one partial row per map task before any shuffle, so skew
never reaches a single reducer with raw rows.

Scores and latencies are doubles and are summed without losing digits: each
is split into a multiple of 2**-20, summed as an exact decimal, and the rest,
which is below 2**-21 and summed as a double. So the order of summation shows
only far below a double's last digit. NaN, infinities and magnitudes from
2**42 on are summed as doubles and stay visible in the average. NULL counts
as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.text import fixed

RUN_KEYS = ("run_id", "model_config_id", "task_file")

SUMMARY_COLUMNS = [
    "run_id", "model_config_id", "task_file", "total_tasks", "total_attempts", "passed", "failed",
    "pass_rate", "average_score", "average_latency_sec", "repeats",
]


_STEP, _LARGE = float(2**20), float(2**42)


def sum_parts(c: str, name: str) -> list[Column]:
    """Aggregates whose ``total`` is the sum of the doubles in ``c``."""
    x = F.col(c).cast("double")
    usual = F.abs(x) < _LARGE  # not so for NaN, which sorts above all
    steps = F.rint(x * _STEP).cast("long")
    return [
        F.sum(F.when(usual, steps).cast("decimal(20,0)")).alias(f"{name}_steps"),
        F.sum(F.when(usual, x - steps / _STEP)).alias(f"{name}_rest"),
        F.sum(F.when(~usual, x)).alias(f"{name}_large"),
    ]


def sum_again(name: str, source: str | None = None) -> list[Column]:
    """Aggregates that add up what ``sum_parts`` made."""
    src = source or name
    return [F.sum(f"{src}_{p}").alias(f"{name}_{p}") for p in ("steps", "rest", "large")]


def total(name: str) -> Column:
    steps = F.coalesce(F.col(f"{name}_steps").cast("double"), F.lit(0.0)) / _STEP
    return F.coalesce(F.col(f"{name}_large"), F.lit(0.0)) + (steps + F.coalesce(F.col(f"{name}_rest"), F.lit(0.0)))


def run_summary(
    attempts: DataFrame,
    keys: Sequence[str] = RUN_KEYS,
    task_key: str = "task_id",
    passed: str = "passed",
    score: str = "score",
    latency: str = "latency_sec",
) -> DataFrame:
    """Aggregate scored attempts to run summaries.

    ``total_tasks`` is the number of distinct tasks, ``repeats`` the largest
    attempt count of a task, ``pass_rate``/averages are 0.0 for an empty run.
    """
    per_task = attempts.groupBy(*keys, task_key).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col(passed)).alias("__p"),
        *sum_parts(score, "__s"),
        *sum_parts(latency, "__l"),
    )
    per_run = per_task.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.sum("__n").alias("total_attempts"),
        F.sum("__p").alias("passed"),
        *sum_again("__s"),
        *sum_again("__l"),
        F.max("__n").cast("int").alias("repeats"),
    )
    return finish_summary(per_run, keys)


def finish_summary(per_run: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Rates and averages from (total_tasks, total_attempts, passed, sums __s and __l, repeats)."""
    n = F.col("total_attempts")
    nz = n > 0
    return per_run.select(
        *keys,
        F.col("total_tasks").cast("bigint").alias("total_tasks"),
        n.cast("bigint").alias("total_attempts"),
        F.col("passed").cast("bigint").alias("passed"),
        (n - F.col("passed")).cast("bigint").alias("failed"),
        F.when(nz, F.col("passed") / n).otherwise(F.lit(0.0)).alias("pass_rate"),
        F.when(nz, total("__s") / n).otherwise(F.lit(0.0)).alias("average_score"),
        F.when(nz, total("__l") / n).otherwise(F.lit(0.0)).alias("average_latency_sec"),
        F.col("repeats").cast("int").alias("repeats"),
    )


def summary_for_planned_runs(attempts: DataFrame, planned_runs: DataFrame, keys: Sequence[str] = RUN_KEYS, **kw) -> DataFrame:
    """Summaries for every planned run, zeros for runs without attempts.

    ``planned_runs`` has ``keys`` plus optional ``total_tasks``/``repeats``
    columns (the run's plan); a run with no attempts still gets a row.
    """
    s = run_summary(attempts, keys, **kw)
    p = planned_runs
    for c, default in (("total_tasks", None), ("repeats", None)):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(default).cast("bigint"))
    p = p.select(*keys, F.col("total_tasks").alias("__pt"), F.col("repeats").alias("__pr"))
    j = p.join(s, list(keys), "left")
    return j.select(
        *keys,
        F.coalesce("__pt", "total_tasks", F.lit(0)).cast("bigint").alias("total_tasks"),
        F.coalesce("total_attempts", F.lit(0)).cast("bigint").alias("total_attempts"),
        F.coalesce("passed", F.lit(0)).cast("bigint").alias("passed"),
        F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"),
        F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"),
        F.coalesce("average_score", F.lit(0.0)).alias("average_score"),
        F.coalesce("average_latency_sec", F.lit(0.0)).alias("average_latency_sec"),
        F.coalesce("__pr", "repeats", F.lit(1)).cast("int").alias("repeats"),
    )


def partial_summary(
    completed: DataFrame, planned: DataFrame, keys: Sequence[str] = RUN_KEYS, **kw
) -> DataFrame:
    """Summaries of unfinished runs: over ``completed`` attempts, with ``planned_attempts``
    (rows of ``planned`` per run) and ``completion_ratio``."""
    counts = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned_attempts"))
    done = run_summary(completed, keys, **kw).join(counts, list(keys))
    return done.withColumn("completion_ratio", F.col("total_attempts") / F.col("planned_attempts"))


def total_tasks_compat(summary: DataFrame) -> DataFrame:
    """``total_tasks`` the way a runner without a task count derives it:
    ``total_attempts // repeats`` (``repeats == 0`` keeps the attempt count)."""
    r = F.col("repeats")
    return summary.withColumn(
        "total_tasks_derived",
        F.when(r != 0, F.floor(F.col("total_attempts") / r)).otherwise(F.col("total_attempts")).cast("bigint"),
    )


def format_summary(summary: DataFrame) -> DataFrame:
    """The persisted text form: rates and score with 4 decimals, latency with 3."""
    return summary.select(
        "run_id", "model_config_id", "task_file",
        F.col("total_tasks").cast("string").alias("total_tasks"),
        F.col("total_attempts").cast("string").alias("total_attempts"),
        F.col("passed").cast("string").alias("passed"),
        F.col("failed").cast("string").alias("failed"),
        fixed("pass_rate", 4).alias("pass_rate"),
        fixed("average_score", 4).alias("average_score"),
        fixed("average_latency_sec", 3).alias("average_latency_sec"),
        F.col("repeats").cast("string").alias("repeats"),
    )


def console_summary(summary: DataFrame) -> DataFrame:
    """The end-of-run console lines, one row per run."""
    return summary.select(
        "run_id", "model_config_id", "task_file",
        F.format_string("Total tasks: %d (repeats=%d, total_attempts=%d)", "total_tasks", "repeats", "total_attempts").alias("line_tasks"),
        F.format_string("Passed: %d", "passed").alias("line_passed"),
        F.concat(F.lit("Average score: "), fixed("average_score", 2)).alias("line_score"),
        F.concat(F.lit("Average latency: "), fixed("average_latency_sec", 2), F.lit("s")).alias("line_latency"),
    )
