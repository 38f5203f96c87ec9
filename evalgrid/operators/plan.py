"""Run planning: repeat expansion, dry-run plans, attempt ordinals, resume.

Repeat expansion is ``explode(sequence(0, n - 1))`` (a generator, not a
join); ordinals are row numbers within the run; resume is a left anti join
of the plan against what is already done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.operators.sequence import _by_keys, row_number_within


def expand_repeats(tasks: DataFrame, repeats) -> DataFrame:
    """One row per (task, repeat): ``repeat_index`` 0..n-1 and ``repeat_count`` n.

    ``repeats`` is an int or a column; ``n <= 0`` gives no rows
    (``sequence(0, -1)`` would count down, hence the guard).
    """
    n = repeats if isinstance(repeats, Column) else F.lit(int(repeats))
    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    exploded = tasks.withColumn("repeat_index", F.explode(seq))
    return exploded.withColumn("repeat_index", F.col("repeat_index").cast("int")).withColumn("repeat_count", n.cast("int"))


def plan_lines(tasks: DataFrame, runs: DataFrame, repeats: int) -> DataFrame:
    """Dry-run plan, nothing executed: for each planned run (``runs``: one row
    per (model_config_id, task_file)) the task count, the attempt total and one
    line per task ``  <id>: "<description>" -> <scorer>``.

    ``runs`` and ``tasks`` meet on ``task_file`` (an equi-join: each task
    appears once per run that uses its file). Runs and their task counts are
    one row per model and task file: Spark broadcasts them while they are
    small, and adaptive execution splits a task file with most tasks beyond.
    """
    counts = tasks.groupBy("task_file").agg(F.count(F.lit(1)).alias("tasks"))
    planned = runs.select("model_config_id", "task_file").join(counts, "task_file")
    per_task = tasks.select(
        "task_file", "line_no",
        F.concat(F.lit("  "), F.col("id"), F.lit(': "'), F.col("description"), F.lit('" -> '), F.col("scorer")).alias("line"),
    )
    return planned.join(per_task, "task_file").withColumn("total_attempts", F.col("tasks") * F.lit(int(repeats)))


def attempt_ordinals(attempts: DataFrame, run_keys: Sequence[str], order: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """``ordinal`` (1-based position in plan order within the run) and ``total``.

    ``run_keys + order`` must identify an attempt; ``bucket`` as in
    ``row_number_within``, for runs too large for one task. The total is a
    grouped count joined back, NULL keys included.
    """
    numbered = row_number_within(attempts, list(run_keys), list(order), out="ordinal", bucket=bucket)
    totals = attempts.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("total"))
    return _by_keys(numbered, totals, list(run_keys))


def first_n_tasks(tasks: DataFrame, n: int, per: Sequence[str] = ("task_file",), order: Sequence[str] = ("line_no",)) -> DataFrame:
    """The run option "max tasks": the first ``n`` tasks of each task file in file order.

    Spark keeps ``n`` rows a group in each task before the shuffle (a window
    group limit), so a large task file costs no more than a small one.
    """
    numbered = tasks.withColumn("__rn", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return numbered.filter(F.col("__rn") <= n).drop("__rn")


def missing_attempts(plan: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Resume planning: planned attempts with no completed counterpart (left anti join)."""
    return plan.join(completed.select(*keys).dropDuplicates(list(keys)), list(keys), "left_anti")
