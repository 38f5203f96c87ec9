"""Run manifests from an append-only log of status events, and their listings.

A run's manifest is the merge of its events: of each field the last value that
is not null, by event time and a tie-break. The merge is a ``max`` of (order,
value) structs, so partial manifests of batches, hours or tasks merge into the
same result in any order, a re-delivered event changes nothing, and a run with
very many events is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.jsonv import json_kind_sql, vget_sql, with_strict_json
from evalgrid.operators.runs import RUN_STATUSES

# Fields of a manifest beside its keys, status and times; allowed changes of a run's status
# (a cancelled or failed run may be resumed, a completed one is final).
MANIFEST_FIELDS = {
    "model_name": "string", "suite_id": "string", "suite_name": "string", "server_url": "string", "settings": "string",
    "repeats": "bigint", "total_tasks": "bigint", "total_attempts": "bigint",
}
STATUS_CHANGES = (
    ("running", "completed"), ("running", "cancelled"), ("running", "failed"), ("cancelled", "running"), ("failed", "running"),
)
# The fields of a full run summary, in their order.
REPORT_COLUMNS = (
    "run_id", "model_config_id", "model_name", "suite_id", "suite_name", "task_file", "run_folder", "status",
    "total_tasks", "total_attempts", "passed", "failed", "pass_rate", "average_score", "average_latency_sec",
    "repeats", "artifact_count", "started_at", "completed_at",
)
LISTING_COLUMNS = (
    "model_config_id", "run_id", "task_file", "suite_id", "status", "average_score", "pass_rate", "average_latency_sec",
    "artifact_count",
)
RUN_KEYS = ("run_id", "model_config_id", "task_file")


def _last(value: Column, ts: str, tiebreak: str) -> Column:
    """Partial state of a field: its last value that is not null, with the event's place."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(tiebreak).alias("seq"), value.alias("value"))))


def manifest_partials(events: DataFrame, keys: Sequence[str] = RUN_KEYS, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """One mergeable row per run: first and last event time and each field's last value.

    Fields of ``MANIFEST_FIELDS`` that ``events`` lacks stay NULL; other
    columns are not read. A status that is none of ``RUN_STATUSES`` does not
    count, nor does an event without a time."""
    known = F.when(F.col("status").isin(*RUN_STATUSES), F.col("status"))
    fields = {f: F.col(f).cast(t) if f in events.columns else F.lit(None).cast(t) for f, t in MANIFEST_FIELDS.items()}
    timed = events.filter(F.col(ts).isNotNull())
    return timed.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        _last(known, ts, tiebreak).alias("last_status"),
        *(_last(c, ts, tiebreak).alias(f"last_{f}") for f, c in fields.items()),
    )


def merge_partials(partials: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Partials of any batches as one row per run."""
    return partials.groupBy(*keys).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *(F.max(f"last_{f}").alias(f"last_{f}") for f in ("status", *MANIFEST_FIELDS)),
    )


def manifests(
    partials: DataFrame, keys: Sequence[str] = RUN_KEYS, as_of: datetime | None = None, silent_after: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Manifests from merged partials: keys, fields, status, started_at, completed_at, last_event_at, silent.

    A run without a status event is ``unknown``. ``completed_at`` is the time
    of the status event that ended the run, NULL while it runs. ``silent``
    marks a run that is still running but has had no event in the
    ``silent_after`` before ``as_of`` (without ``as_of``: none is)."""
    status = F.coalesce("last_status.value", F.lit("unknown"))
    ended = status.isin(*[s for s in RUN_STATUSES if s != "running"])
    silent = F.lit(False)
    if as_of is not None:
        silent = (status == "running") & (F.col("last_ts") < F.lit(as_of - silent_after).cast(partials.schema["last_ts"].dataType))
    return partials.select(
        *keys,
        *(F.col(f"last_{f}.value").alias(f) for f in MANIFEST_FIELDS),
        status.alias("status"),
        F.col("first_ts").alias("started_at"),
        F.when(ended, F.col("last_status.ts")).alias("completed_at"),
        F.col("last_ts").alias("last_event_at"),
        silent.alias("silent"),
    )


def run_manifests(
    events: DataFrame, keys: Sequence[str] = RUN_KEYS, ts: str = "ts", tiebreak: str = "event_id",
    as_of: datetime | None = None, silent_after: timedelta = timedelta(hours=1),
) -> DataFrame:
    """``manifests`` of a whole event log."""
    return manifests(manifest_partials(events, keys, ts, tiebreak), keys, as_of, silent_after)


def read_manifests(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Saved manifest documents, damaged ones included: one row per document.

    Run id and model come from the path (``.../<model>/<run id>/manifest.json``),
    so a document that is empty, torn or no JSON object still names its run; it
    has ``corrupt`` true, status ``unknown`` and no fields. A field of the
    wrong type is NULL, a status that is none of ``RUN_STATUSES`` is
    ``unknown``. ``settings`` is a JSON text."""
    folder = F.regexp_extract(F.col(path), r"([^/\\]+)[/\\]([^/\\]+)[/\\][^/\\]+$", 1)
    run = F.regexp_extract(F.col(path), r"([^/\\]+)[/\\]([^/\\]+)[/\\][^/\\]+$", 2)
    rows = documents.select(F.col(path).alias("path"), folder.alias("model_config_id"), run.alias("run_id"), F.col(text).alias("__text"))
    rows = with_strict_json(rows, "__text", "__doc")
    rows = rows.withColumn("corrupt", ~F.coalesce(F.expr(f"{json_kind_sql('__doc')} = 'dict'"), F.lit(False)))

    def field(name: str, kind: str) -> Column:
        value = vget_sql("__doc", f"$.{name}")
        if name == "settings":
            return F.expr(f"CASE WHEN {json_kind_sql(value)} = 'dict' THEN to_json({value}) END")
        if kind == "string":
            return F.expr(f"CASE WHEN {json_kind_sql(value)} = 'str' THEN try_variant_get({value}, '$', 'string') END")
        return F.expr(f"CASE WHEN {json_kind_sql(value)} = 'int' THEN try_variant_get({value}, '$', 'bigint') END")

    status = field("status", "string")
    return rows.select(
        "path", "run_id", "model_config_id", "corrupt", field("task_file", "string").alias("task_file"),
        *(field(f, t).alias(f) for f, t in MANIFEST_FIELDS.items()),
        F.when(status.isin(*RUN_STATUSES), status).otherwise(F.lit("unknown")).alias("status"),
        *(field(f, "string").alias(f) for f in ("started_at", "completed_at")),
    )


def run_folder(model: str = "model_config_id", run_id: str = "run_id") -> Column:
    """``results/runs/<model>/<run id>`` of each row."""
    return F.concat(F.lit("results/runs/"), F.col(model), F.lit("/"), F.col(run_id))


def _with_manifest(summary: DataFrame, manifest: DataFrame, artifacts: DataFrame, how: str) -> DataFrame:
    """Summary rows with their run's manifest and artifact count.

    What a summary has itself (totals, repeats) it keeps."""
    own = [c for c in manifest.columns if c in RUN_KEYS or c not in summary.columns]
    counts = artifacts.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("artifact_count"))
    joined = summary.join(manifest.select(*own), list(RUN_KEYS), how).join(counts, list(RUN_KEYS), "left")
    return joined.withColumns({
        "status": F.coalesce("status", F.lit("unknown")),
        "artifact_count": F.coalesce("artifact_count", F.lit(0)).cast("bigint"),
    })


def run_report(summary: DataFrame, manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Full summary of every summarised run, ``REPORT_COLUMNS``; a run without a manifest is ``unknown``."""
    full = _with_manifest(summary, manifest, artifacts, "left")
    return full.withColumn("run_folder", run_folder()).select(*REPORT_COLUMNS)


def runs_listing(summary: DataFrame, manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every run that has a summary or a manifest, ``LISTING_COLUMNS``; what a run lacks is NULL."""
    return _with_manifest(summary, manifest, artifacts, "full_outer").select(*LISTING_COLUMNS)
