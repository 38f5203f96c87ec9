"""Deterministic scorers over DataFrames.

Scoring is two narrow projections, no shuffle:

1. ``with_task_spec`` reads everything a scorer needs from the task VARIANT
   once, into flat ``spec_*`` columns (run it on the tasks table, before the
   tasks are joined to their many attempts, and it runs once per task);
2. ``score_frame`` derives response features only for the rows whose scorer
   needs them, then evaluates every scorer as one ``CASE`` over the registry.

Each step is its own projection so Catalyst keeps shared sub-expressions as
columns instead of inlining them into one huge expression (which would
overflow the 64 KB generated-method limit and fall back to interpretation).

The result column is ``STRUCT<score DOUBLE, passed BOOLEAN, reason STRING>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.jsontext import json_error_text_sql, member_text_sql
from evalgrid.functions.jsonv import (
    is_json_null_sql,
    json_kind_sql,
    object_keys_sql,
    py_float_of_sql,
    py_nested_sql,
    py_repr_sql,
    py_text_sql,
    vget_sql,
    with_strict_json,
)
from evalgrid.functions.text import fill_sql, first_number_sql, float_repr_sql, lit, py_repr_str_sql, strip_sql

SCORE_TYPE = "struct<score:double,passed:boolean,reason:string>"

# Default numeric tolerance and keyword threshold.
DEFAULT_TOLERANCE = 0.01
DEFAULT_THRESHOLD = 0.7

# Category -> scorer name, and the fallback scorer.
CATEGORY_SCORER_MAP = {
    "math": "numeric_close",
    "numeric": "numeric_close",
    "text": "exact_match",
    "general": "exact_match",
    "keyword": "keyword_match",
    "code": "keyword_match",
    "json": "json_valid",
    "tool": "json_valid",
}
FALLBACK_SCORER = "exact_match"

# The scorers' reason texts. ``{name}`` marks a value filled
# in per row; everything else is literal text.
REASONS = {
    "none_response": "Response is None",
    "missing_expected": "Task is missing 'expected' or 'expected_output' key",
    "expected_none": "Task '{key}' value is None",
    "matched": "Matched expected answer",
    "mismatch": "Expected '{expected}' but got '{got}'",
    "not_numeric": "Task '{key}' is not numeric: {value}",
    "no_number": "No number found in response: '{got}'",
    "tolerance_not_numeric": "Task 'tolerance' is not numeric: {value}",
    "within": "Value {actual} within tolerance {tolerance} of expected {expected}",
    "outside": "Expected {expected} (±{tolerance}) but got {actual}",
    "missing_keywords": "Task is missing 'expected_keywords' or 'metadata.keywords' key",
    "keywords_not_list": "Task keywords ('expected_keywords' or 'metadata.keywords') is not a list: {kind}",
    "no_keywords": "No keywords required",
    "threshold_not_numeric": "Task 'threshold' is not numeric: {value}",
    "keywords_matched": "Matched {m}/{n} keywords (threshold={threshold})",
    "keywords_missing": "Matched {m}/{n} keywords (threshold={threshold}); missing: {missing}",
    "invalid_json": "Invalid JSON",
    "invalid_json_detail": "Invalid JSON: {detail}",
    "not_object": "JSON parsed but result is {kind}, expected object",
    "parsed": "JSON parsed successfully",
    "tool_missing": "Missing 'tool' key (expected '{expected}')",
    "tool_mismatch": "Tool mismatch: expected '{expected}', got '{got}'",
    "tool_matches": "Tool matches: '{expected}'",
    "keys_not_list": "'required_argument_keys' is not a list: {kind}",
    "arguments_missing": "Missing 'arguments' key in response",
    "arguments_not_object": "'arguments' is not an object: {kind}",
    "keys_missing": "Missing argument keys: {keys}",
    "keys_present": "All required argument keys present: {keys}",
    "check_separator": "; ",
    "unknown_scorer": "Unknown scorer: {name}. Supported: {supported}",
}


def msg(reason: str, /, **parts: str) -> str:
    """SQL for ``REASONS[reason]`` with each ``{placeholder}`` filled by SQL text."""
    return fill_sql(REASONS[reason], **parts)


def result(score, passed, reason) -> Column:
    """Build a scorer result struct from Columns or Python values (for custom scorers)."""
    s = score if isinstance(score, Column) else F.lit(float(score))
    p = passed if isinstance(passed, Column) else F.lit(bool(passed))
    r = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(s.cast("double").alias("score"), p.cast("boolean").alias("passed"), r.cast("string").alias("reason"))


# ---------------------------------------------------------------------------
# Task side: one flat spec per task
# ---------------------------------------------------------------------------


def _top_or_meta(t: str, key: str, fallback_on_null: bool, meta_key: str | None = None) -> str:
    """``task.get(key)`` falling back to ``metadata.get(key)``.

    With ``fallback_on_null`` the metadata value is used when the top-level
    value is absent or JSON null; otherwise only when the key is absent.
    A ``metadata`` that is null or not an object acts as an empty object.
    """
    top = vget_sql(t, f"$.{key}")
    meta = vget_sql(t, f"$.metadata.{meta_key or key}")
    use_top = f"({top} IS NOT NULL AND NOT {is_json_null_sql(top)})" if fallback_on_null else f"{top} IS NOT NULL"
    return f"CASE WHEN {use_top} THEN {top} ELSE {meta} END"


def category_map_sql(mapping: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in sorted(mapping.items())) + ")"


def resolve_scorer(category: str, mapping: dict[str, str] | None = None, fallback: str = FALLBACK_SCORER) -> Column:
    """Category -> scorer name (case-sensitive); anything unmapped gets ``fallback``.

    The mapping is a literal map (constant-folded, no join). A mapping too
    large for a literal belongs in a dimension table joined on category.
    """
    m = CATEGORY_SCORER_MAP if mapping is None else mapping
    if not m:
        return F.lit(fallback)
    return F.expr(f"coalesce(element_at({category_map_sql(m)}, {category}), {lit(fallback)})")


SPEC_FIELDS = [
    "category", "scorer",
    "exp_key", "exp_null", "exp_text", "exp_num", "exp_repr", "exp_num_repr",
    "tol_num", "tol_repr", "tol_num_repr",
    "kw_error", "kw", "kw_low", "thr_num", "thr_text", "thr_repr",
    "tool_applies", "tool_kind", "tool_text", "tool_json", "tool_num",
    "req_applies", "req_kind", "req_items",
]


def _stage(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in exprs.items()})


def _nested_text(kind: str, source: str) -> str:
    """Python's text of a list or object from its JSON text ``source``; NULL for other kinds."""
    return f"CASE WHEN {kind} IN ('list', 'dict') THEN {py_nested_sql(source)} END"


def with_task_spec(
    df: DataFrame, task: str = "task", out: str = "spec", category_map: dict[str, str] | None = None, text: str | None = None
) -> DataFrame:
    """Add the scoring spec read from the task VARIANT column ``task`` as flat
    columns ``{out}_{field}`` (``spec_scorer``, ``spec_exp_text``, ...).

    Flat columns, not one struct: a query that uses one scorer reads three
    fields, and column pruning then skips computing the rest.

    ``text`` is the column of the JSON text that ``task`` was parsed from:
    with it expected lists and objects print their names in the text's order,
    without it sorted, as VARIANT keeps them."""
    t = f"`{task}`"
    if text is not None:
        exp_source = member_text_sql(f"`{text}`", "__exp_key")
        holder = f"CASE WHEN {vget_sql(t, '$.expected_tool')} IS NOT NULL THEN `{text}` ELSE {member_text_sql(f'`{text}`', lit('metadata'))} END"
        tool_source = member_text_sql(holder, "'expected_tool'")
    else:
        exp_source, tool_source = "to_json(__exp_v)", "to_json(__tool_v)"
    cmap = CATEGORY_SCORER_MAP if category_map is None else category_map
    df = _stage(
        df,
        {
            "__exp_key": f"CASE WHEN {vget_sql(t, '$.expected')} IS NOT NULL THEN 'expected' "
            f"WHEN {vget_sql(t, '$.expected_output')} IS NOT NULL THEN 'expected_output' END",
            "__exp_v": f"coalesce({vget_sql(t, '$.expected')}, {vget_sql(t, '$.expected_output')})",
            "__tol_v": vget_sql(t, "$.tolerance"),
            "__kw_v": _top_or_meta(t, "expected_keywords", True, meta_key="keywords"),
            "__thr_v": vget_sql(t, "$.threshold"),
            "__tool_v": _top_or_meta(t, "expected_tool", False),
            "__req_v": _top_or_meta(t, "required_argument_keys", False),
            "__cat_v": vget_sql(t, "$.metadata.category"),
        },
    )
    names = ["exp", "tol", "kw", "thr", "tool", "req", "cat"]
    df = _stage(df, {f"__{n}_t": f"schema_of_variant(__{n}_v)" for n in ("kw", "req")})
    df = _stage(df, {f"__{n}_k": json_kind_sql(f"__{n}_v") for n in names})
    df = _stage(df, {"__exp_nested": _nested_text("__exp_k", exp_source), "__tool_nested": _nested_text("__tool_k", tool_source)})
    cmap_sql = f"coalesce(element_at({category_map_sql(cmap)}, __category), {lit(FALLBACK_SCORER)})" if cmap else lit(FALLBACK_SCORER)
    df = _stage(
        df,
        {
            "__category": f"CASE WHEN __cat_k IS NULL THEN '' WHEN __cat_k = 'NoneType' THEN CAST(NULL AS STRING) "
            f"ELSE {py_text_sql('__cat_v', '__cat_k')} END",
            "__exp_null": is_json_null_sql("__exp_v"),
            "__exp_text": strip_sql(f"coalesce(__exp_nested, {py_text_sql('__exp_v', '__exp_k')})"),
            "__exp_num": py_float_of_sql("__exp_v", "__exp_k"),
            "__exp_repr": f"coalesce(__exp_nested, {py_repr_sql('__exp_v', '__exp_k')})",
            "__tol_num": f"CASE WHEN __tol_v IS NULL THEN {DEFAULT_TOLERANCE} ELSE {py_float_of_sql('__tol_v', '__tol_k')} END",
            "__tol_repr": f"CASE WHEN __tol_v IS NULL THEN 'None' ELSE {py_repr_sql('__tol_v', '__tol_k')} END",
            "__kw_error": f"CASE WHEN __kw_k IS NULL OR __kw_k = 'NoneType' THEN {msg('missing_keywords')} "
            f"WHEN __kw_k <> 'list' THEN {msg('keywords_not_list', kind='__kw_k')} END",
            "__kw": f"CASE WHEN __kw_k <> 'list' THEN NULL WHEN __kw_t = 'ARRAY<STRING>' AND NOT exists(try_variant_get(__kw_v, '$', 'array<string>'), x -> x IS NULL) "
            f"THEN try_variant_get(__kw_v, '$', 'array<string>') "
            f"ELSE transform(try_variant_get(__kw_v, '$', 'array<variant>'), e -> {py_text_sql('e')}) END",
            "__thr_num": f"CASE WHEN __thr_v IS NULL THEN {DEFAULT_THRESHOLD} "
            f"WHEN __thr_k IN ('int', 'float', 'bool') THEN {py_float_of_sql('__thr_v', '__thr_k')} END",
            "__thr_text": f"CASE WHEN __thr_v IS NULL THEN {lit(repr(DEFAULT_THRESHOLD))} ELSE {py_text_sql('__thr_v', '__thr_k')} END",
            "__thr_repr": py_repr_sql("__thr_v", "__thr_k"),
            "__tool_applies": "coalesce(__tool_k IS NOT NULL AND __tool_k <> 'NoneType', false)",
            "__tool_kind": "__tool_k",
            "__tool_text": f"coalesce(__tool_nested, {py_text_sql('__tool_v', '__tool_k')})",
            "__tool_json": "to_json(__tool_v)",
            "__tool_num": f"CASE WHEN __tool_k IN ('int', 'float', 'bool') THEN {py_float_of_sql('__tool_v', '__tool_k')} END",
            "__req_applies": "coalesce(__req_k IS NOT NULL AND __req_k <> 'NoneType', false)",
            "__req_kind": "__req_k",
            "__req_items": "CASE WHEN __req_t = 'ARRAY<STRING>' AND NOT exists(try_variant_get(__req_v, '$', 'array<string>'), x -> x IS NULL) "
            "THEN transform(try_variant_get(__req_v, '$', 'array<string>'), "
            "x -> named_struct('is_str', true, 'key', x, 'text', x)) "
            "ELSE transform(try_variant_get(__req_v, '$', 'array<variant>'), e -> named_struct("
            "'is_str', schema_of_variant(e) = 'STRING', 'key', try_variant_get(e, '$', 'string'), "
            f"'text', {py_text_sql('e')})) END",
        },
    )
    df = _stage(
        df,
        {
            "__scorer": f"CASE WHEN __cat_k = 'str' THEN {cmap_sql} ELSE {lit(FALLBACK_SCORER)} END",
            "__exp_num_repr": float_repr_sql("__exp_num"),
            "__tol_num_repr": float_repr_sql("__tol_num"),
            "__kw_low": "transform(__kw, x -> lower(x))",
        },
    )
    df = df.withColumnsRenamed({f"__{f}": f"{out}_{f}" for f in SPEC_FIELDS})
    tmp = [c for c in df.columns if c.startswith("__") and not c.startswith(f"{out}_")]
    return df.drop(*tmp)


# ---------------------------------------------------------------------------
# Scorers over (spec, response features); each returns SQL text
# ---------------------------------------------------------------------------


def _res(score: str, passed: str, reason: str) -> str:
    return f"named_struct('score', CAST({score} AS DOUBLE), 'passed', CAST({passed} AS BOOLEAN), 'reason', CAST({reason} AS STRING))"


def _fail(reason: str) -> str:
    return _res("0.0", "false", reason)


def _makers(opts: dict):
    """(res, fail) builders; with ``with_reason=False`` every reason is NULL,
    so Catalyst prunes the text inputs (reprs, joins) and no string is built."""
    if opts.get("with_reason", True):
        return _res, _fail
    return (lambda score, passed, reason: _res(score, passed, "CAST(NULL AS STRING)")), (lambda reason: _fail("CAST(NULL AS STRING)"))


def _exact(sp: str, **opts) -> str:
    res, fail = _makers(opts)
    key, exp = f"{sp}_exp_key", f"{sp}_exp_text"
    return (
        f"CASE WHEN __r_text IS NULL THEN {fail(msg('none_response'))} "
        f"WHEN {key} IS NULL THEN {fail(msg('missing_expected'))} "
        f"WHEN {sp}_exp_null THEN {fail(msg('expected_none', key=key))} "
        f"WHEN lower({exp}) = lower(__r_strip) THEN {res('1.0', 'true', msg('matched'))} "
        f"ELSE {fail(msg('mismatch', expected=exp, got='__r_strip'))} END"
    )


def _numeric(sp: str, **opts) -> str:
    res, fail = _makers(opts)
    key, e, tol = f"{sp}_exp_key", f"{sp}_exp_num", f"{sp}_tol_num"
    nums = dict(actual="__r_num_repr", tolerance=f"{sp}_tol_num_repr", expected=f"{sp}_exp_num_repr")
    within = f"(abs(__r_num - {e}) <= {tol} AND NOT isnan({tol}))"
    return (
        f"CASE WHEN __r_text IS NULL THEN {fail(msg('none_response'))} "
        f"WHEN {key} IS NULL THEN {fail(msg('missing_expected'))} "
        f"WHEN {e} IS NULL THEN {fail(msg('not_numeric', key=key, value=f'{sp}_exp_repr'))} "
        f"WHEN __r_num_text IS NULL THEN {fail(msg('no_number', got='__r_strip'))} "
        f"WHEN {tol} IS NULL THEN {fail(msg('tolerance_not_numeric', value=f'{sp}_tol_repr'))} "
        f"WHEN {within} THEN {res('1.0', 'true', msg('within', **nums))} "
        f"ELSE {fail(msg('outside', **nums))} END"
    )


def _keyword(sp: str, **opts) -> str:
    res, fail = _makers(opts)
    kws, low = f"{sp}_kw", f"{sp}_kw_low"
    n = f"size({kws})"
    m = f"size(filter({low}, k -> contains(__r_low, k)))"
    missing = f"filter({kws}, (k, i) -> NOT contains(__r_low, element_at({low}, i + 1)))"
    score = f"(CAST({m} AS DOUBLE) / CAST({n} AS DOUBLE))"
    thr = f"{sp}_thr_num"
    counts = dict(m=f"CAST({m} AS STRING)", n=f"CAST({n} AS STRING)", threshold=f"{sp}_thr_text")
    return (
        f"CASE WHEN __r_text IS NULL THEN {fail(msg('none_response'))} "
        f"WHEN {sp}_kw_error IS NOT NULL THEN {fail(f'{sp}_kw_error')} "
        f"WHEN {n} = 0 THEN {res('1.0', 'true', msg('no_keywords'))} "
        f"WHEN {thr} IS NULL THEN {fail(msg('threshold_not_numeric', value=f'{sp}_thr_repr'))} "
        f"WHEN {score} >= {thr} THEN {res(score, 'true', msg('keywords_matched', **counts))} "
        f"ELSE {res(score, 'false', msg('keywords_missing', missing=f'array_join({missing}, {lit(chr(44) + chr(32))})', **counts))} END"
    )


def _json(sp: str, **opts) -> str:
    res, fail = _makers(opts)
    ta, ra = f"{sp}_tool_applies", f"{sp}_req_applies"
    num = "('int', 'float', 'bool')"
    same = (
        f"CASE WHEN __r_tool_kind = 'int' AND {sp}_tool_kind = 'int' THEN __r_tool_json = {sp}_tool_json "
        f"WHEN __r_tool_kind IN {num} AND {sp}_tool_kind IN {num} THEN __r_tool_num = {sp}_tool_num "
        f"ELSE __r_tool_kind = {sp}_tool_kind AND __r_tool_json = {sp}_tool_json END"
    )
    tool_ok = f"({ta} AND __r_tool IS NOT NULL AND coalesce({same}, false))"
    et = f"{sp}_tool_text"
    tool_reason = (
        f"CASE WHEN NOT {ta} THEN CAST(NULL AS STRING) "
        f"WHEN __r_tool IS NULL THEN {msg('tool_missing', expected=et)} "
        f"WHEN NOT {tool_ok} THEN {msg('tool_mismatch', expected=et, got='__r_tool_text')} "
        f"ELSE {msg('tool_matches', expected=et)} END"
    )
    items = f"{sp}_req_items"
    missing = f"transform(filter({items}, it -> NOT it.is_str OR NOT coalesce(array_contains(__r_arg_keys, it.key), false)), it -> it.text)"
    args_missing = "(__r_args_kind IS NULL OR __r_args_kind = 'NoneType')"
    req_list = f"({sp}_req_kind = 'list')"
    req_ok = f"({ra} AND {req_list} AND NOT {args_missing} AND __r_args_kind = 'dict' AND size({missing}) = 0)"
    req_reason = (
        f"CASE WHEN NOT {ra} THEN CAST(NULL AS STRING) "
        f"WHEN NOT {req_list} THEN {msg('keys_not_list', kind=f'{sp}_req_kind')} "
        f"WHEN {args_missing} THEN {msg('arguments_missing')} "
        f"WHEN __r_args_kind <> 'dict' THEN {msg('arguments_not_object', kind='__r_args_kind')} "
        f"WHEN size({missing}) > 0 THEN {msg('keys_missing', keys=f'array_join({missing}, {lit(chr(44) + chr(32))})')} "
        f"ELSE {msg('keys_present', keys=f'array_join(transform({items}, it -> it.text), {lit(chr(44) + chr(32))})')} END"
    )
    total = f"(1 + CAST({ta} AS INT) + CAST({ra} AS INT))"
    ok = f"(1 + CAST({tool_ok} AS INT) + CAST({req_ok} AS INT))"
    score = f"round(CAST({ok} AS DOUBLE) / CAST({total} AS DOUBLE), 4)"
    reason = f"concat_ws({msg('check_separator')}, {msg('parsed')}, {tool_reason}, {req_reason})"
    invalid = f"coalesce({msg('invalid_json_detail', detail='__r_json_err')}, {msg('invalid_json')})"
    return (
        f"CASE WHEN __r_text IS NULL THEN {fail(msg('none_response'))} "
        f"WHEN __r_json IS NULL THEN {fail(invalid)} "
        f"WHEN __r_jkind <> 'dict' THEN {fail(msg('not_object', kind='__r_jkind'))} "
        f"ELSE {res(score, f'{ok} = {total}', reason)} END"
    )


# ---------------------------------------------------------------------------
# Registry and dispatch
# ---------------------------------------------------------------------------

SpecBuilder = Callable[[str], str]

# name -> (SQL builder over the spec + response features, features it needs)
_REGISTRY: dict[str, tuple[SpecBuilder, frozenset]] = {
    "exact_match": (_exact, frozenset({"strip"})),
    "numeric_close": (_numeric, frozenset({"strip", "num"})),
    "keyword_match": (_keyword, frozenset({"low"})),
    "json_valid": (_json, frozenset({"json"})),
}
# custom scorers: name -> builder(task VARIANT column, response column) -> result struct Column
_CUSTOM: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(name: str, builder: Callable[[Column, Column], Column]) -> None:
    """Add a scorer ``builder(task_variant, response) -> STRUCT<score,passed,reason>``.

    A builder is a Column expression (or an Arrow ``pandas_udf`` for logic
    with no Column form); it is dispatched like the built-ins.
    """
    _CUSTOM[name] = builder


def unregister_scorer(name: str) -> None:
    _CUSTOM.pop(name, None)


def supported_scorers() -> list[str]:
    return sorted(set(_REGISTRY) | set(_CUSTOM))


def get_scorer(name: str) -> str:
    """Validate a scorer name like the registry lookup: unknown names raise ``ValueError``."""
    if name not in _REGISTRY and name not in _CUSTOM:
        raise ValueError(REASONS["unknown_scorer"].format(name=repr(name), supported=", ".join(supported_scorers())))
    return name


def unknown_scorer_sql(name_sql: str) -> str:
    """``Unknown scorer: 'x'. Supported: a, b`` for a name expression."""
    return msg("unknown_scorer", name=py_repr_str_sql(name_sql), supported=lit(", ".join(supported_scorers())))


def score_frame(
    df: DataFrame,
    response: str = "response",
    spec: str = "spec",
    scorer: str | None = None,
    out: str = "result",
    task: str | None = None,
    with_reason: bool = True,
) -> DataFrame:
    """Score every row: adds ``out`` = STRUCT<score, passed, reason>.

    A response that is no JSON is read once more, token by token, for the
    message of Python's decoder. ``with_reason=False`` leaves ``reason`` NULL: a summary that reads only
    score and passed then builds no reason text at all.

    ``scorer`` is either one scorer name for every row, or None to use each
    row's ``{spec}_scorer``. ``spec`` comes from ``with_task_spec``; ``task``
    (the raw VARIANT) is only needed by custom scorers.
    """
    sp = spec
    known = set(_REGISTRY) | set(_CUSTOM)
    if scorer is not None:
        names = [scorer] if scorer in known else []
        name_sql = lit(scorer)
    else:
        names = supported_scorers()
        name_sql = f"{sp}_scorer"
    needs: dict[str, set] = {}
    for n in names:
        for feat in _REGISTRY.get(n, (None, frozenset()))[1]:
            needs.setdefault(feat, set()).add(n)

    def gate(feat: str, expr: str, typ: str) -> str:
        users = needs.get(feat, set())
        if not users:
            return f"CAST(NULL AS {typ})"
        if len(names) == 1:
            return expr
        return f"CASE WHEN __name IN ({', '.join(lit(u) for u in sorted(users))}) THEN {expr} END"

    df = _stage(df, {"__name": name_sql, "__r_text": f"CAST(`{response}` AS STRING)"})
    df = _stage(
        df,
        {
            "__r_strip": gate("strip", strip_sql("__r_text"), "STRING"),
            "__r_low": gate("low", "lower(__r_text)", "STRING"),
            "__r_num_text": gate("num", first_number_sql("__r_text"), "STRING"),
            "__r_json_text": gate("json", "__r_text", "STRING"),
        },
    )
    if "num" in needs:
        df = _stage(df, {"__r_num": "CAST(__r_num_text AS DOUBLE)"})
        df = _stage(df, {"__r_num_repr": float_repr_sql("__r_num")})
    if "json" in needs:
        df = with_strict_json(df, "__r_json_text", "__r_json")
        rejected = f"CASE WHEN __r_json IS NULL AND __r_json_text IS NOT NULL THEN {json_error_text_sql(strip_sql('__r_text'))} END"
        df = _stage(df, {"__r_json_err": rejected if with_reason else "CAST(NULL AS STRING)"})
        df = _stage(
            df,
            {
                "__r_jkind": json_kind_sql("__r_json"),
                "__r_tool": vget_sql("__r_json", "$.tool"),
                "__r_args": vget_sql("__r_json", "$.arguments"),
            },
        )
        df = _stage(
            df,
            {
                "__r_tool_kind": json_kind_sql("__r_tool"),
                "__r_args_kind": json_kind_sql("__r_args"),
                "__r_arg_keys": object_keys_sql("__r_args"),
            },
        )
        df = _stage(
            df,
            {
                "__r_tool_text": f"coalesce({_nested_text('__r_tool_kind', member_text_sql('__r_text', lit('tool')))}, {py_text_sql('__r_tool', '__r_tool_kind')})",
                "__r_tool_json": "to_json(__r_tool)",
                "__r_tool_num": f"CASE WHEN __r_tool_kind IN ('int', 'float', 'bool') THEN {py_float_of_sql('__r_tool', '__r_tool_kind')} END",
            },
        )
    fallback = _fail(unknown_scorer_sql("__name") if with_reason else "CAST(NULL AS STRING)")
    builtin = [n for n in names if n in _REGISTRY]
    expr_sql = (
        "CASE " + " ".join(f"WHEN __name = {lit(n)} THEN {_REGISTRY[n][0](sp, with_reason=with_reason)}" for n in builtin) + f" ELSE {fallback} END"
        if builtin
        else fallback
    )
    expr = F.expr(expr_sql)
    custom = [n for n in names if n not in _REGISTRY]
    if custom:
        if task is None:
            raise ValueError(f"custom scorers {custom} need the raw task column (task=...)")
        for n in custom:
            expr = F.when(F.col("__name") == n, _CUSTOM[n](F.col(task), F.col("__r_text"))).otherwise(expr)
    tmp = [c for c in df.columns if c.startswith("__")]
    return df.withColumn(out, expr).drop(*tmp)


def score_tasks(df: DataFrame, task: str = "task", response: str = "response", scorer: str | None = None, out: str = "result") -> DataFrame:
    """Convenience: spec + score in one call, for frames that carry the raw task."""
    return score_frame(with_task_spec(df, task=task, out="__spec"), response=response, spec="__spec", scorer=scorer, out=out, task=task)
