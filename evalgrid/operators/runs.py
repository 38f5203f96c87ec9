"""Suites, run manifests and run-level reports.

Suites and manifests are small dimension tables next to the attempt/summary
facts. Every lookup is an equi-join or an aggregate; latest-status and
latest-run picks are ``max_by`` aggregates (map-side partial, skew-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.functions.jsonv import with_strict_json
from evalgrid.operators.leaderboard import latest_per_group, sort_order

RUN_STATUSES = ("running", "completed", "cancelled", "failed")
# Categories whose responses are saved as artifacts, default extension.
ARTIFACT_CATEGORIES = ("code", "coding")
ARTIFACT_EXT = ".md"


def tasks_by_suite(tasks: DataFrame, suites: DataFrame) -> DataFrame:
    """Tasks resolved through the suite that names their task file."""
    return tasks.join(suites.select("suite_id", "task_file"), "task_file")


def require_suites(suite_ids: Sequence[str], suites: DataFrame) -> DataFrame:
    """The named suites; ``ValueError`` if one is not registered (a lookup of the few names asked for)."""
    chosen = suites.filter(F.col("suite_id").isin(list(suite_ids)))
    unknown = sorted(set(suite_ids) - {r.suite_id for r in chosen.select("suite_id").distinct().collect()})
    if unknown:
        raise ValueError(f"Unknown suite id: {', '.join(unknown)}")
    return chosen


def suites_without_tasks(suites: DataFrame, tasks: DataFrame) -> DataFrame:
    """Suites whose task file has no (valid) tasks, or does not exist."""
    return suites.join(tasks.select("task_file").distinct(), "task_file", "left_anti")


def with_suite_scorers(
    df: DataFrame, suites: DataFrame, rules: DataFrame, category: str = "spec_category", scorer: str = "spec_scorer"
) -> DataFrame:
    """Scorers chosen by the suite that names a row's ``task_file``: adds ``suite_id``, replaces ``scorer``.

    ``suites`` (suite_id, task_file, scoring); ``rules`` (scoring, category,
    scorer), where a NULL category stands for all that the scoring does not
    name. What no rule covers, rows of a task file without a suite too, keeps
    its scorer. A task file of several suites is scored once for each. Of two
    rules for the same category the smaller scorer name counts. Rules are
    folded to one row per scoring and suites to one per task file and suite
    before they meet ``df``, in one join without a hint.
    """
    single = rules.groupBy("scoring", "category").agg(F.min("scorer").alias("scorer"))
    named = F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "scorer")))
    folded = single.groupBy("scoring").agg(
        F.map_from_entries(named).alias("__by_category"),
        F.max(F.when(F.col("category").isNull(), F.col("scorer"))).alias("__any_other"),
    )
    chosen = suites.select("suite_id", "task_file", "scoring").distinct().join(folded, "scoring", "left").drop("scoring")
    own = F.coalesce(F.expr(f"__by_category[{category}]"), F.col("__any_other"), F.col(scorer))
    return df.join(chosen, "task_file", "left").withColumn(scorer, own).drop("__by_category", "__any_other")


def latest_status(events: DataFrame, keys: Sequence[str], ts: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Current status per run from append-only status events: the status of the
    latest event (``max_by`` on (ts, tiebreak)), plus the first event's time and,
    once the run has left ``running``, the last one's."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    latest = events.groupBy(*keys).agg(
        F.max_by("status", order).alias("status"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("finished_at"),
    )
    return latest.withColumn("finished_at", F.when(F.col("status") != "running", F.col("finished_at")))


def artifact_rows(attempts: DataFrame, suite_col: str, id_col: str, ext: str = ARTIFACT_EXT,
                  categories: Sequence[str] = ARTIFACT_CATEGORIES) -> DataFrame:
    """Artifact path per coding attempt: ``artifacts/<suite>/<sanitized id>_response<ext>``.

    A column ``artifact_extension`` (a task's metadata) overrides ``ext``, with
    or without its dot. The response text stays in the table (the attempt keeps
    it too); ``write_artifacts`` saves it."""
    suffix = F.lit(ext)
    if "artifact_extension" in attempts.columns:
        own = F.col("artifact_extension")
        suffix = F.coalesce(F.when(own.startswith("."), own), F.concat(F.lit("."), own), suffix)
    coding = attempts.filter(F.col("category").isin(*categories))
    safe = F.regexp_replace(F.col(id_col), r"[^A-Za-z0-9._-]", "_")
    return coding.withColumn(
        "artifact_path", F.concat(F.lit("artifacts/"), F.col(suite_col), F.lit("/"), safe, F.lit("_response"), suffix)
    )


def write_artifacts(artifacts: DataFrame, path: str, response: str = "response") -> None:
    """Artifact texts as a table under ``path``, one row per artifact path (the attempts of a run by its keys)."""
    artifacts.select("run_id", "model_config_id", "artifact_path", F.col(response).alias("text")).write.mode("append").partitionBy(
        "run_id"
    ).parquet(path)


def full_summary(summary: DataFrame, status: DataFrame, suites: DataFrame, artifacts: DataFrame,
                 run_keys: Sequence[str] = ("run_id", "model_config_id", "task_file")) -> DataFrame:
    """Run summary + manifest status/timestamps + suite + artifact count (0 when none)."""
    counts = artifacts.groupBy(*run_keys).agg(F.count(F.lit(1)).alias("artifact_count"))
    j = (
        summary.join(status, list(run_keys), "left")
        .join(suites.select("suite_id", "task_file"), "task_file", "left")
        .join(counts, list(run_keys), "left")
    )
    return j.withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0)).cast("bigint")).withColumn(
        "status", F.coalesce("status", F.lit("unknown"))
    )


def suite_leaderboard(summary_with_suite: DataFrame) -> DataFrame:
    """Latest run per (model, suite), ranked within each suite (1 = best).

    The window runs on the deduplicated table (one row per model and suite)."""
    latest = latest_per_group(summary_with_suite, ("model_config_id", "suite_id"), "run_id")
    w = Window.partitionBy("suite_id").orderBy(*sort_order())
    return latest.withColumn("rank", F.rank().over(w))


def runs_overview(summary: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every run known from either side; a missing manifest reads as ``unknown``."""
    j = summary.join(status, list(keys), "full_outer")
    return j.withColumn("status", F.coalesce("status", F.lit("unknown")))


def response_consistency(attempts: DataFrame, keys: Sequence[str], response: str = "response") -> DataFrame:
    """Distinct responses per task in a run (1 = every repeat answered alike)."""
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_distinct(F.col(response)).alias("unique_responses")
    )


def raw_line_report(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Lines, corrupt lines (no strict JSON) and completed attempts of raw result files, per ``keys``."""
    checked = with_strict_json(lines, f"`{line}`", "__json").withColumn("__ok", F.col("__json").isNotNull()).drop("__json")
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("__ok")).alias("corrupt_lines"),
        F.count_if(F.col("__ok")).alias("completed_attempts"),
    )
