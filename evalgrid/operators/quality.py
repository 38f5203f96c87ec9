"""Data-quality jobs for the documented work-item format.

Rules are data: each rule is (name, violation predicate SQL, message SQL).
All rules are evaluated in one projection into an array of violations which
is exploded to one row per violation, so adding a rule never adds a pass
over the data. Uniqueness, references and transitions are aggregates or
equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evalgrid.operators.sequence import previous_within, with_quantile_bucket

# Allowed enums, id pattern, limits and status transitions.
TYPES = ("code_review", "bug_fix", "feature", "documentation", "refactoring", "testing", "research", "other")
STATUSES = ("pending", "in_progress", "blocked", "completed", "cancelled")
ID_RE = r"^[a-zA-Z0-9_-]+$"
DATETIME_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
ALLOWED_TRANSITIONS = (
    ("pending", "in_progress"),
    ("in_progress", "blocked"),
    ("in_progress", "completed"),
    ("pending", "cancelled"),
    ("blocked", "in_progress"),
)
DEFAULTS = {"priority": 3, "status": "pending"}


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def default_rules() -> list[tuple[str, str, str]]:
    """(rule, violated-when SQL, message SQL) over work-item columns."""
    return [
        ("id_format", f"NOT (id RLIKE r'{ID_RE}') OR length(id) > 100", "concat('invalid id: ', id)"),
        ("type_enum", f"type IS NULL OR type NOT IN {_in(TYPES)}", "concat('invalid type: ', coalesce(type, 'null'))"),
        ("priority_range", "priority IS NULL OR priority < 1 OR priority > 5", "concat('priority out of range: ', coalesce(CAST(priority AS STRING), 'null'))"),
        ("status_enum", f"status IS NULL OR status NOT IN {_in(STATUSES)}", "concat('invalid status: ', coalesce(status, 'null'))"),
        ("due_date_format", f"NOT (due_date RLIKE r'{DATETIME_RE}') OR try_to_timestamp(due_date, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") IS NULL",
         "concat('invalid due_date: ', due_date)"),
        ("hours_range", "estimated_hours IS NOT NULL AND (estimated_hours < 0.1 OR estimated_hours > 999.99)",
         "concat('estimated_hours out of range: ', CAST(estimated_hours AS STRING))"),
        ("hours_precision", "estimated_hours IS NOT NULL AND CAST(estimated_hours AS DECIMAL(20,2)) <> CAST(estimated_hours AS DECIMAL(24,10))",
         "concat('estimated_hours has more than 2 decimals: ', CAST(estimated_hours AS STRING))"),
    ]


# Most characters of text fields, most items of arrays, most keys of metadata.
MAX_CHARS = {"description": 10_000, "assignee": 100, "title": 200, "source": 100, "external_id": 100}
MAX_ITEMS = {"tags": 20, "dependencies": 50}
MAX_TAG_CHARS, MAX_METADATA_KEYS, MAX_METADATA_CHARS = 50, 50, 10_000


def _hours_rules(field: str) -> list[tuple[str, str, str]]:
    odd = f"isnan({field}) OR abs({field}) = double('inf')"
    text = f"CAST({field} AS STRING)"
    return [
        (f"{field}_finite", f"{field} IS NOT NULL AND ({odd})", f"concat('{field} is not a finite number: ', {text})"),
        (f"{field}_range", f"{field} IS NOT NULL AND NOT ({odd}) AND ({field} < 0.1 OR {field} > 999.99)",
         f"concat('{field} out of range: ', {text})"),
        (f"{field}_precision", f"{field} IS NOT NULL AND NOT ({odd}) AND CAST({field} AS DECIMAL(20,2)) <> CAST({field} AS DECIMAL(24,10))",
         f"concat('{field} has more than 2 decimals: ', {text})"),
    ]


def further_rules(columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """Rules for the optional work-item fields among ``columns`` (a NULL optional field violates none).

    ``tags`` and ``dependencies`` are arrays of strings, ``metadata`` a map of
    strings, hours doubles.
    """
    rules = [
        (f"{f}_length", f"coalesce(length({f}) > {n}, false)", f"concat('{f} longer than {n} characters: ', CAST(length({f}) AS STRING))")
        for f, n in MAX_CHARS.items()
        if f in columns
    ]
    if "description" in columns:
        rules.append(("description_newline", "coalesce(contains(description, '\\n'), false)", "'description contains a newline'"))
    rules += [
        (f"{f}_count", f"coalesce(size({f}) > {n}, false)", f"concat('{f} has more than {n} items: ', CAST(size({f}) AS STRING))")
        for f, n in MAX_ITEMS.items()
        if f in columns
    ]
    if "tags" in columns:
        bad = f"filter(tags, t -> t IS NULL OR NOT (t RLIKE r'{ID_RE}') OR length(t) > {MAX_TAG_CHARS})"
        rules.append(("tags_format", f"coalesce(size({bad}) > 0, false)", f"concat('invalid tags: ', array_join({bad}, ', ', 'null'))"))
    if "metadata" in columns:
        long = f"map_keys(map_filter(metadata, (k, v) -> length(v) > {MAX_METADATA_CHARS}))"
        rules += [
            ("metadata_count", f"coalesce(size(metadata) > {MAX_METADATA_KEYS}, false)",
             f"concat('metadata has more than {MAX_METADATA_KEYS} keys: ', CAST(size(metadata) AS STRING))"),
            ("metadata_length", f"coalesce(size({long}) > 0, false)", f"concat('metadata values too long: ', array_join({long}, ', '))"),
        ]
    if "actual_hours" in columns:
        rules += _hours_rules("actual_hours")
    for f in ("created_at", "updated_at"):
        if f in columns:
            ok = f"{f} RLIKE r'{DATETIME_RE}' AND try_to_timestamp({f}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") IS NOT NULL"
            rules.append((f"{f}_format", f"{f} IS NOT NULL AND NOT coalesce({ok}, false)", f"concat('invalid {f}: ', {f})"))
    return rules


def rule_violations(items: DataFrame, key: str = "id", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per (item, violated rule): key, rule, message.

    Without ``rules``: ``default_rules`` and ``further_rules`` of the fields there are.
    """
    rules = rules or default_rules() + further_rules(items.columns)
    arr = "filter(array(" + ", ".join(
        f"CASE WHEN coalesce({pred}, true) THEN named_struct('rule', '{name}', 'message', {msg}) END" for name, pred, msg in rules
    ) + "), v -> v IS NOT NULL)"
    return items.select(F.col(key), F.explode(F.expr(arr)).alias("v")).select(key, "v.rule", "v.message")


def duplicate_keys(rows: DataFrame, keys: Sequence[str], line: str = "line_no") -> DataFrame:
    """Keys that occur more than once, with the count and the first line."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min(line).alias("first_line"))
        .filter(F.col("occurrences") > 1)
    )


def dangling_references(items: DataFrame, ref_col: str, key: str = "id") -> DataFrame:
    """Rows whose reference names no existing key (left anti join).

    ``ref_col`` may be an array (a task's ``dependencies``): then one row for
    each element that names none, with the element in its place.
    """
    keys = items.select(F.col(key).alias(ref_col)).distinct()
    if isinstance(items.schema[ref_col].dataType, ArrayType):
        items = items.withColumn(ref_col, F.explode(ref_col))
    return items.filter(F.col(ref_col).isNotNull()).join(keys, ref_col, "left_anti").select(*items.columns)


def invalid_transitions(
    events: DataFrame, entity: str | Sequence[str], order: Sequence[str], status: str = "status", ident: str = "id",
    bucket: Column | None = None, allowed: Sequence[tuple[str, str]] = ALLOWED_TRANSITIONS, long_history: int | None = 200_000,
) -> DataFrame:
    """Consecutive status changes per entity (one key or several) that are not ``allowed``.

    Each row meets the one before it by a window over the entity (a NULL
    entity has a history like any other). Unchanged statuses are not
    transitions. A history of more than ``long_history`` rows is cut into
    stretches by quantiles of the first ``order`` column, a number, date or
    timestamp, so that many tasks share it; of each stretch its last row is
    handed to the next. A ``bucket`` (as in ``row_number_within``) replaces
    the quantiles; ``long_history=None`` leaves every history whole.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    rows = events.select(*keys, *dict.fromkeys([*order, status, ident]))
    if bucket is None and long_history is not None:
        rows = with_quantile_bucket(rows, keys, order[0], "__stretch", long_history)
        bucket = F.col("__stretch")
    pairs = previous_within(rows, keys, list(order), {status: "from_status", ident: "from_id"}, bucket)
    pairs = pairs.select(*keys, "from_status", "from_id", F.col(status).alias("to_status"), F.col(ident).alias("to_id"))
    pairs = pairs.filter(F.col("from_status") != F.col("to_status"))
    pairs_allowed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed])
    return pairs.filter(~F.array_contains(pairs_allowed, F.struct(F.col("from_status").alias("a"), F.col("to_status").alias("b"))))


def upsert(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key; the rest of ``base`` stays."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def word_count(col: str) -> F.Column:
    """``len(s.split())``: runs of Python whitespace separate words."""
    from evalgrid.functions.text import PY_SPACE

    return F.size(F.filter(F.split(F.col(col), PY_SPACE + "+"), lambda w: w != ""))


def prompt_size(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``chars``, ``words`` and ``estimated_context_tokens`` (a token per four characters, rounded up) of a text."""
    chars = F.char_length(text)
    return df.select(
        *keep,
        chars.cast("bigint").alias("chars"),
        word_count(text).alias("words"),
        F.ceil(chars / F.lit(4.0)).cast("bigint").alias("estimated_context_tokens"),
    )


def apply_defaults(tasks: DataFrame, task: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    """Priority, status, number of dependencies and metadata of task VARIANTs, defaults where absent or null."""
    return tasks.select(
        *keep,
        F.expr(f"coalesce(try_variant_get({task}, '$.priority', 'int'), {DEFAULTS['priority']})").alias("priority"),
        F.expr(f"coalesce(try_variant_get({task}, '$.status', 'string'), '{DEFAULTS['status']}')").alias("status"),
        F.expr(f"coalesce(size(try_variant_get({task}, '$.dependencies', 'array<variant>')), 0)").alias("n_dependencies"),
        F.expr(f"coalesce(to_json(try_variant_get({task}, '$.metadata', 'variant')), '{{}}')").alias("metadata"),
    )


def enrich(items: DataFrame, text: str, dependencies: str, keep: Sequence[str]) -> DataFrame:
    """``word_count`` of a text and ``has_dependencies`` (a non-empty array)."""
    depends = F.coalesce(F.size(dependencies) > 0, F.lit(False))
    return items.select(*keep, word_count(text).alias("word_count"), depends.alias("has_dependencies"))


#: Legacy field, its type, the current field, the default: fixed values of the migration.
LEGACY_FIELDS = (
    ("id", "string", "id", "''"),
    ("category", "string", "type", "'other'"),
    ("urgency", "int", "priority", "3"),
    ("state", "string", "status", "'pending'"),
    ("notes", "string", "description", "''"),
    ("owner", "string", "assignee", "''"),
    ("deadline", "string", "due_date", "''"),
)


def migrate_legacy(legacy: DataFrame, task: str = "v", source: str = "old_format") -> DataFrame:
    """Current fields of legacy task VARIANTs; ``metadata`` names the source and keeps the legacy fields not mapped.

    ``metadata`` is a map of JSON texts.
    """
    known = ", ".join(f"'{old}'" for old, *_ in LEGACY_FIELDS)
    rest = (
        f"transform_values(map_filter(try_variant_get({task}, '$', 'map<string,variant>'), (k, v) -> k NOT IN ({known})), (k, v) -> to_json(v))"
    )
    return legacy.select(
        *(F.expr(f"coalesce(try_variant_get({task}, '$.{old}', '{t}'), {default})").alias(new) for old, t, new, default in LEGACY_FIELDS),
        F.lit(source).alias("legacy_source"),
        F.expr(f"map_concat(map('legacy_source', '\"{source}\"'), coalesce({rest}, map()))").alias("metadata"),
    )
