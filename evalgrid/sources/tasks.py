"""JSONL task files: scan, line numbers, parse, validate.

``scan_lines`` reads any number of JSONL files (a glob or a directory)
with Spark's text source. Physical line numbers are exact even when a large
file is split across many tasks: every split counts its own lines, a small
per-split table (one row per input split) turns the counts into offsets, and
each line adds its offset to its position inside the split. No task ever
holds a whole file.

``parse_task_lines`` turns (task_file, line_no, line) rows into valid tasks
and an error table. Each line yields at most one error, chosen in the
loader's order: invalid JSON -> not an object -> missing required fields ->
field types -> empty values. ``mode="failfast"`` raises on the first error
(lowest line number) like a single-file loader; the default keeps both
tables ("quarantine").
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evalgrid.functions.jsontext import json_beginning_sql, json_error_sql
from evalgrid.functions.jsonv import json_kind_sql, object_keys_sql, py_text_sql, vget_sql, with_strict_json
from evalgrid.functions.text import fill_sql, lit, strip_sql
from evalgrid.operators.scorers import with_task_spec

# The required task fields (sorted, as listed in messages).
REQUIRED_FIELDS = ["description", "expected_output", "id"]

ERROR_COLUMNS = ["task_file", "line_no", "error_type", "field", "message", "raw_line"]

# Loader and validation messages. ``{line}`` is the physical
# line number, other ``{slots}`` are filled per row.
MESSAGES = {
    "invalid_json": "Invalid JSON on line {line}{detail}",
    "not_object": "Line {line}: Expected JSON object, got {kind}",
    "missing_fields": "Line {line}: Missing required fields: {fields}",
    "id_type": "Line {line}: 'id' must be a string or integer",
    "description_type": "Line {line}: 'description' must be a string",
    "expected_output_type": "Line {line}: 'expected_output' must be a string",
    "id_empty": "Line {line}: 'id' cannot be empty",
    "description_empty": "Line {line}: 'description' cannot be empty",
    "expected_output_empty": "Line {line}: 'expected_output' cannot be empty",
    "field_none": "Field '{name}' cannot be None",
    "field_type": "Field '{name}' must be of type {type}",
    "field_empty": "Field '{name}' cannot be empty",
    "no_tasks": "No tasks found in task file.",
}


def _stage(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in exprs.items()})


def scan_lines(spark: SparkSession, path: str, name_col: str | None = None, naming: str = "uri") -> DataFrame:
    """(task_file, line_no, line) for every physical line of the files under ``path``.

    Blank lines are kept (they count for numbering). ``_metadata`` gives the
    file and the split each line came from. ``task_file`` is the file's URI;
    with ``naming="as_given"`` the part of it from ``path`` (up to its first
    wildcard) on, which is what a call log that names ``data/tasks/x.jsonl``
    holds; with ``naming="stem"`` the file name without its extension; or the
    value of the partition column ``name_col`` for a partitioned directory
    with one file per partition.
    """
    uri = F.col("_metadata.file_path")
    if naming == "as_given":
        base = re.split(r"[*?\[{]", path)[0]
        name = F.substr(uri, F.greatest(F.locate(base, uri), F.lit(1)))
    elif naming == "stem":
        name = F.regexp_extract(uri, r"([^/]+?)(\.[^./]*)?$", 1)
    elif naming == "uri":
        name = uri
    else:
        raise ValueError(f"unknown naming {naming!r}")
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"Task file not found: {path}") from e
        raise
    base = raw.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("__file"),
        (F.col(name_col) if name_col else name).alias("task_file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__pos"),
    )
    return number_lines(base)


def number_lines(base: DataFrame) -> DataFrame:
    """Line numbers from (task_file, __split, __pos, line) rows of a file scan.

    Rows of one split are contiguous in one scan partition and ``__pos``
    increases along them, so position-in-split is ``__pos - min(__pos)``. The
    table of offsets has one row for each split of the input; under Spark's
    byte threshold it is broadcast and the lines stay where they are.
    """
    if "__file" not in base.columns:
        base = base.withColumn("__file", F.col("task_file"))
    splits = base.groupBy("__file", "__split").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")
    )
    w = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    j = base.join(splits.select("__file", "__split", "__before", "__first"), ["__file", "__split"])
    return j.select(
        "task_file",
        (F.col("__before") + F.col("__pos") - F.col("__first") + F.lit(1)).alias("line_no"),
        "line",
    )


def _checked(lines: DataFrame) -> DataFrame:
    """Parse and classify every non-blank line (one projection chain, no shuffle).

    A line that is no JSON is read once more, token by token, for the message
    of Python's decoder."""
    df = lines.filter(F.expr(f"{strip_sql('line')} <> ''"))
    df = with_strict_json(df, "line", "raw")
    df = _stage(df, {"__json_msg": f"CASE WHEN raw IS NULL THEN {json_error_sql(strip_sql('line'))}.message END"})
    df = _stage(df, {"__kind": json_kind_sql("raw")})
    df = _stage(
        df,
        {
            "__keys": f"CASE WHEN __kind = 'dict' THEN {object_keys_sql('raw')} END",
            "__id_v": vget_sql("raw", "$.id"),
            "__desc_v": vget_sql("raw", "$.description"),
            "__exp_v": vget_sql("raw", "$.expected_output"),
        },
    )
    df = _stage(
        df,
        {
            "__missing": "array_except(array('description', 'expected_output', 'id'), __keys)",
            "__id_k": json_kind_sql("__id_v"),
            "__desc_k": json_kind_sql("__desc_v"),
            "__exp_k": json_kind_sql("__exp_v"),
        },
    )
    ln = "CAST(line_no AS STRING)"

    def m(key: str, **parts: str) -> str:
        return fill_sql(MESSAGES[key], line=ln, **parts)

    def e(kind: str, field: str | None, message: str) -> str:
        f = f"'{field}'" if field else "CAST(NULL AS STRING)"
        return f"named_struct('t', '{kind}', 'f', {f}, 'm', {message})"

    detail = "CASE WHEN coalesce(__json_msg, '') = '' THEN '' ELSE concat(': ', __json_msg) END"
    missing_list = "array_join(__missing, ', ')"
    err = (
        "CASE "
        f"WHEN raw IS NULL THEN {e('parsing', None, m('invalid_json', detail=detail))} "
        f"WHEN __kind <> 'dict' THEN {e('not_object', None, m('not_object', kind='__kind'))} "
        f"WHEN size(__missing) > 0 THEN {e('validation', 'required_fields', m('missing_fields', fields=missing_list))} "
        f"WHEN __id_k NOT IN ('str', 'int', 'bool') THEN {e('validation', 'id', m('id_type'))} "
        f"WHEN __desc_k <> 'str' THEN {e('validation', 'description', m('description_type'))} "
        f"WHEN __exp_k <> 'str' THEN {e('validation', 'expected_output', m('expected_output_type'))} "
        f"WHEN __id_k = 'str' AND try_variant_get(__id_v, '$', 'string') = '' THEN {e('validation', 'id', m('id_empty'))} "
        f"WHEN try_variant_get(__desc_v, '$', 'string') = '' THEN {e('validation', 'description', m('description_empty'))} "
        f"WHEN try_variant_get(__exp_v, '$', 'string') = '' THEN {e('validation', 'expected_output', m('expected_output_empty'))} "
        "END"
    )
    df = _stage(df, {"__err": err, "__id_text": py_text_sql("__id_v", "__id_k")})
    return parse_barrier(df, lines.columns)


def parse_barrier(df: DataFrame, keep: list[str]) -> DataFrame:
    """Emit the computed columns through ``inline(array(struct(...)))``.

    Callers filter on parse results (``__err IS NOT NULL``, ``__kind =
    'dict'``). Pushed below the projections, such a filter would inline the
    whole parse into the predicate and parse each line again (Catalyst
    substitutes aliases when it pushes predicates). A filter on generator
    output stays above the generator, so every line is parsed exactly once.
    """
    computed = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(c) for c in computed]))))


def parse_task_lines(lines: DataFrame, category_map: dict[str, str] | None = None,
                     validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tasks, errors) from (task_file, line_no, line) rows.

    tasks: task_file, line_no, id (text), description, expected_output,
    category, scorer, raw (VARIANT) and the scoring spec as ``spec_*`` columns.
    errors: task_file, line_no, error_type, field, message, raw_line.
    """
    df = _checked(lines)
    bad = F.col("__err").isNotNull()
    if not validate:  # objects that lack fields are tasks too
        bad = bad & (F.col("__err.t") != "validation")
    errors = df.filter(bad).select(
        "task_file", "line_no",
        F.col("__err.t").alias("error_type"), F.col("__err.f").alias("field"), F.col("__err.m").alias("message"),
        F.col("line").alias("raw_line"),
    )
    ok = df.filter(~bad).select(
        "task_file", "line_no",
        F.col("__id_text").alias("id"),
        F.expr("try_variant_get(__desc_v, '$', 'string')").alias("description"),
        F.expr("try_variant_get(__exp_v, '$', 'string')").alias("expected_output"),
        "raw", "line",
    )
    tasks = with_task_spec(ok, task="raw", out="spec", category_map=category_map, text="line").drop("line").withColumns(
        {"category": F.col("spec_category"), "scorer": F.col("spec_scorer")}
    )
    return tasks, errors


def error_records(lines: DataFrame) -> DataFrame:
    """Of every line in error task_file, line, error_type, message, details and task_partial.

    ``details`` is a struct of what the error type has: ``char`` (where the
    decoder stopped in the stripped line, from 0), ``kind`` (what a line that
    is no object holds), ``field`` and ``missing`` (names); the others are null.
    ``task_partial`` is a JSON object: of an object that breaks a rule the
    stripped line, of broken JSON its longest valid beginning with open
    brackets closed; null where no object begins. Lines that load and blank
    ones give no row.
    """
    line = strip_sql("line")
    df = _checked(lines).filter(F.col("__err").isNotNull())
    df = _stage(df, {"__text": line, "__type": "__err.t"})
    df = _stage(
        df,
        {
            "__char": f"CASE WHEN __type = 'parsing' THEN {json_error_sql('__text')}.place END",
            "__saved": f"CASE __type WHEN 'parsing' THEN {json_beginning_sql('__text')} WHEN 'validation' THEN __text END",
        },
    )
    details = (
        "named_struct('char', __char, 'kind', CASE WHEN __type = 'not_object' THEN __kind END, 'field', __err.f, "
        "'missing', CASE WHEN size(__missing) > 0 THEN __missing END)"
    )
    return df.select(
        "task_file", F.col("line_no").alias("line"), F.col("__type").alias("error_type"), F.col("__err.m").alias("message"),
        F.expr(details).alias("details"), F.expr("CASE WHEN startswith(__saved, '{') THEN __saved END").alias("task_partial"),
    )


def first_errors(errors: DataFrame) -> DataFrame:
    """The first error (lowest line number) of each task file: what a fail-fast load reports.

    An aggregate (``min_by``), so a file with many bad lines is reduced map-side.
    """
    best = errors.groupBy("task_file").agg(
        F.min_by(F.struct(*[F.col(c) for c in ERROR_COLUMNS if c != "task_file"]), F.col("line_no")).alias("e")
    )
    return best.select("task_file", *[F.col("e")[c].alias(c) for c in ERROR_COLUMNS if c != "task_file"])


def load_tasks(lines_or_path, spark: SparkSession | None = None, mode: str = "quarantine",
               validate: bool = True, max_lines: int | None = None, naming: str = "uri"):
    """Load tasks from a path (JSONL files) or a lines DataFrame.

    ``validate=False`` checks only that a line is a JSON object; ``max_lines``
    reads the first lines of each file; ``naming`` as in ``scan_lines``.

    ``quarantine`` returns ``(tasks, errors)``. ``failfast`` raises
    ``ValueError`` with the first error's message (lowest line of the first
    file in path order) and, like the single-file loader, ``ValueError("No
    tasks found")`` is left to the caller (see ``require_tasks``).
    """
    if isinstance(lines_or_path, str):
        if spark is None:
            raise ValueError("spark session required to read a path")
        lines = scan_lines(spark, lines_or_path, naming=naming)
    else:
        lines = lines_or_path
    if max_lines is not None:
        lines = lines.filter(F.col("line_no") <= max_lines)
    tasks, errors = parse_task_lines(lines, validate=validate)
    if mode == "failfast":
        first = first_errors(errors).orderBy("task_file", "line_no").limit(1).collect()
        if first:
            raise ValueError(first[0].message)
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    return tasks, errors


def load_metrics(lines: DataFrame) -> DataFrame:
    """Per task file the lines that load, the lines in error, and whether all load."""
    counts = _checked(lines).groupBy("task_file").agg(
        F.count_if(F.col("__err").isNull()).alias("loaded"), F.count_if(F.col("__err").isNotNull()).alias("errors")
    )
    return counts.withColumn("success", F.col("errors") == 0)


def require_tasks(tasks: DataFrame) -> DataFrame:
    """Raise ``ValueError('No tasks found in task file.')`` when there are no tasks."""
    if tasks.isEmpty():
        raise ValueError(MESSAGES["no_tasks"])
    return tasks


def validate_field(value_variant: str, field_name: str, expected_kind: str | None = None):
    """Generic single-field check -> STRUCT<ok BOOLEAN, message STRING>.

    Null/absent: "Field 'x' cannot be None"; wrong kind: "Field 'x' must be
    of type t"; blank string (after strip): "Field 'x' cannot be empty".
    ``expected_kind`` is a Python type name (str, int, float, bool, list, dict).
    """
    k = f"({json_kind_sql(value_variant)})"
    q = chr(39)
    name = lit(field_name)
    checks = [f"WHEN {k} IS NULL OR {k} = 'NoneType' THEN named_struct('ok', false, 'message', {fill_sql(MESSAGES['field_none'], name=name)})"]
    if expected_kind:
        kinds = {"int": "('int', 'bool')", "float": "('float')"}.get(expected_kind, f"('{expected_kind}')")
        checks.append(
            f"WHEN {k} NOT IN {kinds} THEN named_struct('ok', false, 'message', "
            f"{fill_sql(MESSAGES['field_type'], name=name, type=lit(expected_kind))})"
        )
    checks.append(
        f"WHEN {k} = 'str' AND {strip_sql(f'try_variant_get({value_variant}, {q}${q}, {q}string{q})')} = '' "
        f"THEN named_struct('ok', false, 'message', {fill_sql(MESSAGES['field_empty'], name=name)})"
    )
    return F.expr("CASE " + " ".join(checks) + " ELSE named_struct('ok', true, 'message', '') END")
