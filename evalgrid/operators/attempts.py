"""Attempt rows: tasks x repeats x model responses, scored, with settings.

Joins here are the only shuffles between scoring and summary:

* plan x responses is an equi-join on the full attempt key (run, model,
  task file, task, repeat): both sides hash-partitioned on it; a key matches
  at most one response, so no key can be hot on both sides, and AQE's
  skew-join split covers a skewed side;
* attempts x configs: configs are one row per model. The join carries no
  hint: Spark broadcasts them while their bytes are under its threshold,
  and adaptive execution splits a skewed side beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPT_KEYS = ("run_id", "model_config_id", "task_file", "task_id", "repeat_index")
SETTINGS_FIELDS = ("context_size", "temperature", "top_p", "max_tokens")

def settings_of(configs: DataFrame) -> DataFrame:
    """(model_config_id, settings STRUCT<context_size, temperature, top_p, max_tokens>)."""
    return configs.select(
        F.col("id").alias("model_config_id"),
        F.struct(*[F.col(f"settings.{f}").alias(f) for f in SETTINGS_FIELDS]).alias("settings"),
    )


def with_settings(attempts: DataFrame, configs: DataFrame) -> DataFrame:
    """Attach each attempt's model settings (left join; unknown models get NULL settings)."""
    return attempts.join(settings_of(configs), "model_config_id", "left")


def request_payload(prompt: str = "prompt", settings: str = "settings") -> F.Column:
    """The chat-completions request body for one attempt, as JSON text (a setting that is null is sent as null)."""
    return F.to_json(
        F.struct(
            F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"),
            F.col(f"{settings}.temperature").alias("temperature"),
            F.col(f"{settings}.top_p").alias("top_p"),
            F.col(f"{settings}.max_tokens").alias("max_tokens"),
        ),
        {"ignoreNullFields": "false"},
    )


def join_responses(
    plan: DataFrame,
    responses: DataFrame,
    keys: Sequence[str] = ATTEMPT_KEYS,
    missing_reason: str = "No response",
) -> DataFrame:
    """Every planned attempt with its response; planned attempts without one
    get ``error = missing_reason`` (they become error attempts, not gaps)."""
    r = responses.withColumn("__has", F.lit(True))
    j = plan.join(r, list(keys), "left")
    err = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    return j.withColumn("error", F.when(F.col("__has").isNull(), F.lit(missing_reason)).otherwise(err)).drop("__has")


def attempt_rows(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The attempt record: successful rows keep response/latency/score;
    rows with ``error`` become error rows (empty response, latency 0.0,
    score 0.0, not passed, reason = error text)."""
    has_err = F.col("error").isNotNull() if "error" in scored.columns else F.lit(False)
    err = F.col("error") if "error" in scored.columns else F.lit(None).cast("string")
    return scored.select(
        *keep, "run_id", "model_config_id", "task_id", "category", "task_file",
        F.col("prompt").alias("prompt"),
        F.coalesce(F.col("expected_output"), F.lit("")).alias("expected"),
        F.when(has_err, F.lit("")).otherwise(F.col("response")).alias("response"),
        F.when(has_err, F.lit(0.0)).otherwise(F.col("latency_sec")).alias("latency_sec"),
        F.when(has_err, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(has_err, F.lit(False)).otherwise(F.col("passed")).alias("passed"),
        F.when(has_err, err).otherwise(F.col("reason")).alias("reason"),
        *[c for c in ("settings", "repeat_index", "repeat_count") if c in scored.columns],
    )
