"""Registered queries: name -> (Spark query over the given tables, DuckDB oracle SQL).

Every query reads the driver's parquet tables through the fixture views and
runs the library operators over all of their rows.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators import leaderboard as lb
from evalgrid.operators import scorers as sc
from evalgrid.operators import summary as sm
from evalgrid.plans import fixtures as fx
from evalgrid.plans import oracle as orc

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------


def scored_attempts(spark: SparkSession, sf_dir: str, with_reason: bool = True) -> DataFrame:
    """Every attempt of the fixture scored by its category's scorer."""
    df = sc.with_task_spec(fx.attempt_input(spark, sf_dir), task="task")
    df = sc.score_frame(df, response="response", spec="spec", with_reason=with_reason)
    return df.select(
        "event_id", "run_id", "model_config_id", "task_file", "task_id", "category",
        F.col("spec_scorer").alias("scorer"), "prompt", "expected_output", "response", "latency_sec",
        F.col("result.score").alias("score"), F.col("result.passed").alias("passed"), F.col("result.reason").alias("reason"),
    )


def _one_scorer(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sc.with_task_spec(fx.attempt_input(spark, sf_dir), task="task")
        df = sc.score_frame(df, response="response", spec="spec", scorer=name)
        return df.select(
            "event_id", F.lit(name).alias("scorer"),
            F.col("result.score").alias("score"), F.col("result.passed").alias("passed"), F.col("result.reason").alias("reason"),
        )

    return run


for _name in ("exact_match", "numeric_close", "keyword_match", "json_valid"):
    register(f"score_{_name}", (lambda n=_name: orc.scored_one(n)))(_one_scorer(_name))


@register("score_all", orc.scored_all)
def q_score_all(spark, sf_dir):
    return scored_attempts(spark, sf_dir)


def _json_errors_sql() -> str:
    x = orc.strip("text")
    kind = (
        "CASE WHEN starts_with(x, '{') THEN 'dict' WHEN starts_with(x, '[') THEN 'list' WHEN starts_with(x, '\"') THEN 'str' ELSE 'float' END"
    )
    return f"""SELECT event_id, CASE WHEN error IS NULL THEN {kind} END AS kind, error
        FROM (SELECT event_id, {x} AS x, {orc.json_error_text(x)} AS error FROM ({fx.select_sql(fx.JSON_TEXTS, "events")}))"""


@register("json_errors", _json_errors_sql)
def q_json_errors(spark, sf_dir):
    from evalgrid.functions.jsonv import with_json_verdict

    return with_json_verdict(fx.json_texts(spark, sf_dir), "text").select("event_id", "kind", "error")


@register(
    "json_beginnings",
    lambda: f"""SELECT event_id, {orc.json_beginning(orc.strip("text"))} AS saved FROM ({fx.select_sql(fx.JSON_TEXTS, "events")})""",
)
def q_json_beginnings(spark, sf_dir):
    from evalgrid.functions.jsontext import json_beginning_sql
    from evalgrid.functions.text import strip_sql

    return fx.json_texts(spark, sf_dir).select("event_id", F.expr(json_beginning_sql(strip_sql("text"))).alias("saved"))


@register(
    "score_expected_values",
    lambda: f"""SELECT event_id, CASE half WHEN 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, half = 0 AS passed,
        CASE half WHEN 0 THEN 'Matched expected answer' ELSE 'Expected ' || chr(39) || said || chr(39) || ' but got ' || chr(39) || 'other' || chr(39) END AS reason
        FROM ({fx.select_sql(fx.VALUED_TASKS, "events")})""",
)
def q_score_expected_values(spark, sf_dir):
    from evalgrid.sources.tasks import parse_task_lines

    rows = fx.valued_tasks(spark, sf_dir)
    tasks, _ = parse_task_lines(rows.select("task_file", "line_no", "line"))
    scored = sc.score_frame(tasks.join(rows.select("line_no", "response"), "line_no"))
    return scored.select(F.col("line_no").alias("event_id"), F.col("result.score").alias("score"),
                         F.col("result.passed").alias("passed"), F.col("result.reason").alias("reason"))


# A category map that routes one category to a scorer nobody registered.
_MAP_WITH_UNKNOWN = {**sc.CATEGORY_SCORER_MAP, "unmapped": "semantic_similarity"}


def _unknown_scorer_sql() -> str:
    unknown = "'Unknown scorer: ''semantic_similarity''. Supported: exact_match, json_valid, keyword_match, numeric_close'"
    return f"""SELECT event_id, CASE WHEN category = 'unmapped' THEN 'semantic_similarity' ELSE scorer END AS scorer,
        CASE WHEN category = 'unmapped' THEN 0.0 ELSE score END AS score,
        CASE WHEN category = 'unmapped' THEN false ELSE passed END AS passed,
        CASE WHEN category = 'unmapped' THEN {unknown} ELSE reason END AS reason FROM ({orc.scored_all()})"""


@register("score_unknown_scorer", _unknown_scorer_sql)
def q_score_unknown_scorer(spark, sf_dir):
    df = sc.with_task_spec(fx.attempt_input(spark, sf_dir), task="task", category_map=_MAP_WITH_UNKNOWN)
    df = sc.score_frame(df, response="response", spec="spec")
    return df.select("event_id", F.col("spec_scorer").alias("scorer"), F.col("result.score").alias("score"),
                     F.col("result.passed").alias("passed"), F.col("result.reason").alias("reason"))


@register("resolve_scorer", lambda: f"SELECT event_id, category, {orc.CATEGORY_CASE} AS scorer FROM ({fx.attempt_input_sql()})")
def q_resolve_scorer(spark, sf_dir):
    df = sc.with_task_spec(fx.attempt_input(spark, sf_dir), task="task")
    return df.select("event_id", F.col("spec_category").alias("category"), F.col("spec_scorer").alias("scorer"))


# ---------------------------------------------------------------------------
# Summary and leaderboard
# ---------------------------------------------------------------------------


def summary_of_fixture(spark, sf_dir):
    # summaries read score and passed only: no reason text is built
    return sm.run_summary(scored_attempts(spark, sf_dir, with_reason=False))


@register("run_summary", orc.run_summary_sql)
def q_run_summary(spark, sf_dir):
    return summary_of_fixture(spark, sf_dir)


@register(
    "run_summary_formatted",
    lambda: f"""SELECT run_id, model_config_id, task_file, CAST(total_tasks AS VARCHAR) AS total_tasks,
        CAST(total_attempts AS VARCHAR) AS total_attempts, CAST(passed AS VARCHAR) AS passed, CAST(failed AS VARCHAR) AS failed,
        printf('%.4f', pass_rate) AS pass_rate, printf('%.4f', average_score) AS average_score,
        printf('%.3f', average_latency_sec) AS average_latency_sec, CAST(repeats AS VARCHAR) AS repeats
        FROM ({orc.run_summary_sql()})""",
)
def q_run_summary_formatted(spark, sf_dir):
    return sm.format_summary(summary_of_fixture(spark, sf_dir))


@register(
    "run_summary_console",
    lambda: f"""SELECT run_id, model_config_id, task_file,
        'Total tasks: ' || CAST(total_tasks AS VARCHAR) || ' (repeats=' || CAST(repeats AS VARCHAR) || ', total_attempts='
            || CAST(total_attempts AS VARCHAR) || ')' AS line_tasks,
        'Passed: ' || CAST(passed AS VARCHAR) AS line_passed,
        'Average score: ' || printf('%.2f', average_score) AS line_score,
        'Average latency: ' || printf('%.2f', average_latency_sec) || 's' AS line_latency
        FROM ({orc.run_summary_sql()})""",
)
def q_run_summary_console(spark, sf_dir):
    return sm.console_summary(summary_of_fixture(spark, sf_dir))


@register(
    "total_tasks_derived",
    lambda: f"""SELECT *, CAST(CASE WHEN repeats <> 0 THEN total_attempts // repeats ELSE total_attempts END AS BIGINT)
        AS total_tasks_derived FROM ({orc.run_summary_sql()})""",
)
def q_total_tasks_derived(spark, sf_dir):
    return sm.total_tasks_compat(summary_of_fixture(spark, sf_dir))


@register(
    "leaderboard_latest",
    lambda: f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_config_id, task_file
        ORDER BY run_id DESC) AS rn FROM ({orc.run_summary_sql()})) WHERE rn = 1""",
)
def q_leaderboard_latest(spark, sf_dir):
    return lb.latest_per_group(summary_of_fixture(spark, sf_dir))


@register("leaderboard", lambda: orc.latest_sql(orc.run_summary_sql()))
def q_leaderboard(spark, sf_dir):
    return lb.leaderboard(summary_of_fixture(spark, sf_dir))


@register("leaderboard_markdown", lambda: orc.markdown_sql(orc.latest_sql(orc.run_summary_sql())))
def q_leaderboard_markdown(spark, sf_dir):
    return lb.markdown_rows(lb.leaderboard(summary_of_fixture(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Task files: scan, parse, validate
# ---------------------------------------------------------------------------

from evalgrid.sources import tasks as src_tasks  # noqa: E402


def parsed_fixture(spark, sf_dir):
    return src_tasks.parse_task_lines(fx.task_lines(spark, sf_dir))


@register("scan_tasks", orc.scan_tasks_sql)
def q_scan_tasks(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return tasks.select("task_file", "line_no", "id", "description", "expected_output", "category", "scorer")


@register("task_errors", orc.task_errors_sql)
def q_task_errors(spark, sf_dir):
    _, errors = parsed_fixture(spark, sf_dir)
    return errors


@register("error_records", orc.error_records_sql)
def q_error_records(spark, sf_dir):
    rows = src_tasks.error_records(fx.task_lines(spark, sf_dir))
    d = F.col("details")
    return rows.select("task_file", "line", "error_type", "message", d.char.alias("char"), d.kind.alias("kind"), d.field.alias("field"),
                       F.array_join(d.missing, ", ").alias("missing"), "task_partial")


@register(
    "first_task_error",
    lambda: f"""SELECT task_file, line_no, error_type, field, message, raw_line FROM (
        SELECT *, row_number() OVER (PARTITION BY task_file ORDER BY line_no) AS rn FROM ({orc.task_errors_sql()})) WHERE rn = 1""",
)
def q_first_task_error(spark, sf_dir):
    _, errors = parsed_fixture(spark, sf_dir)
    return src_tasks.first_errors(errors)


def _validation_subset(fields: tuple[str, ...] | None, containing: str | None = None):
    def run(spark, sf_dir):
        _, errors = parsed_fixture(spark, sf_dir)
        e = errors.filter(F.col("error_type") == "validation")
        if fields is not None:
            e = e.filter(F.col("field").isin(*fields))
        if containing is not None:
            e = e.filter(F.col("message").contains(containing))
        return e.select("task_file", "line_no", "field", "message")

    return run


def _validation_subset_sql(fields: tuple[str, ...] | None, containing: str | None = None):
    def make():
        cond = "" if fields is None else " AND field IN (" + ", ".join(f"'{f}'" for f in fields) + ")"
        if containing is not None:
            cond += f" AND contains(message, '{containing}')"
        return f"SELECT task_file, line_no, field, message FROM ({orc.task_errors_sql()}) WHERE error_type = 'validation'{cond}"

    return make


register("validate_required", _validation_subset_sql(("required_fields",)))(_validation_subset(("required_fields",)))
register("validate_types", _validation_subset_sql(("id", "description", "expected_output"), "must be"))(
    _validation_subset(("id", "description", "expected_output"), "must be")
)
register("validate_task", _validation_subset_sql(None))(_validation_subset(None))


@register(
    "validate_values",
    lambda: f"""SELECT task_file, line_no, field, message FROM ({orc.task_errors_sql()})
        WHERE error_type = 'validation' AND message LIKE '%cannot be empty'""",
)
def q_validate_values(spark, sf_dir):
    _, errors = parsed_fixture(spark, sf_dir)
    return errors.filter((F.col("error_type") == "validation") & F.col("message").endswith("cannot be empty")).select(
        "task_file", "line_no", "field", "message"
    )


@register(
    "validate_field",
    lambda: f"""SELECT task_file, line_no,
        CASE WHEN d_k IS NULL OR d_k = 'NoneType' THEN false WHEN d_k <> 'str' THEN false
             WHEN {orc.strip("json_extract_string(j, '$.description')")} = '' THEN false ELSE true END AS ok,
        CASE WHEN d_k IS NULL OR d_k = 'NoneType' THEN 'Field ''description'' cannot be None'
             WHEN d_k <> 'str' THEN 'Field ''description'' must be of type str'
             WHEN {orc.strip("json_extract_string(j, '$.description')")} = '' THEN 'Field ''description'' cannot be empty' ELSE '' END AS message
        FROM (SELECT *, CASE json_type(j, '$.description') WHEN 'VARCHAR' THEN 'str' WHEN 'NULL' THEN 'NoneType'
              WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float'
              WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' END AS d_k
              FROM ({orc.checked_lines_sql()}) WHERE json_type(j) = 'OBJECT')""",
)
def q_validate_field(spark, sf_dir):
    df = src_tasks._checked(fx.task_lines(spark, sf_dir)).filter(F.col("__kind") == "dict")
    chk = src_tasks.validate_field("__desc_v", "description", "str")
    return df.select("task_file", "line_no", chk["ok"].alias("ok"), chk["message"].alias("message"))


# ---------------------------------------------------------------------------
# Configs, call logs, planning, attempts
# ---------------------------------------------------------------------------

from evalgrid.operators import attempts as at  # noqa: E402
from evalgrid.operators import plan as pl  # noqa: E402
from evalgrid.sources import configs as cfg  # noqa: E402
from evalgrid.sources import responses as rsp  # noqa: E402

_CONFIG_ORACLE = f"""
WITH m AS (SELECT DISTINCT user_id % 5 AS m FROM events), e AS (SELECT DISTINCT event_type AS e FROM events)
SELECT 'configs/model-' || CAST(m AS VARCHAR) || '.yaml' AS config_file, 'model-' || CAST(m AS VARCHAR) AS id,
       CAST(NULL AS VARCHAR) AS error FROM m
UNION ALL
SELECT 'configs/' || e || '.yaml',
       CASE e WHEN 'click' THEN 'cfg-click' WHEN 'purchase' THEN 'model-0' END,
       CASE e WHEN 'view' THEN 'Missing required top-level key(s): runtime, settings'
              WHEN 'signup' THEN 'Missing required key ''max_tokens'' in ''settings'''
              WHEN 'error' THEN 'Config file must contain a YAML mapping (dict), got list' END
FROM e"""


@register("model_configs", lambda: _CONFIG_ORACLE)
def q_model_configs(spark, sf_dir):
    configs, errors = cfg.load_configs(fx.config_texts(spark, sf_dir))
    ok = configs.select("config_file", "id", F.lit(None).cast("string").alias("error"))
    bad = errors.select("config_file", F.lit(None).cast("string").alias("id"), F.col("message").alias("error"))
    return ok.unionByName(bad)


@register(
    "duplicate_model_ids",
    lambda: f"""SELECT id, CAST(count(*) AS BIGINT) AS n_files, min(config_file) AS first_file, max(config_file) AS last_file
        FROM ({_CONFIG_ORACLE}) WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
)
def q_duplicate_model_ids(spark, sf_dir):
    configs, _ = cfg.load_configs(fx.config_texts(spark, sf_dir))
    return cfg.duplicate_ids(configs)


@register(
    "attempt_settings",
    lambda: f"""SELECT a.event_id, a.model_config_id, s.context_size, s.temperature, s.top_p, s.max_tokens
        FROM ({fx.attempt_input_sql()}) a LEFT JOIN ({fx.MODEL_SETTINGS_SQL}) s USING (model_config_id)""",
)
def q_attempt_settings(spark, sf_dir):
    a = fx.attempt_input(spark, sf_dir).select("event_id", "model_config_id")
    j = at.with_settings(a, fx.model_configs(spark, sf_dir))
    return j.select("event_id", "model_config_id", *[F.col(f"settings.{f}").alias(f) for f in at.SETTINGS_FIELDS])


@register(
    "request_payloads",
    lambda: f"""SELECT a.event_id, json_object('messages', json_array(json_object('role', 'user', 'content', a.prompt)),
        'temperature', s.temperature, 'top_p', s.top_p, 'max_tokens', s.max_tokens) AS payload
        FROM ({fx.attempt_input_sql()}) a JOIN ({fx.MODEL_SETTINGS_SQL}) s USING (model_config_id)""",
)
def q_request_payloads(spark, sf_dir):
    a = fx.attempt_input(spark, sf_dir).select("event_id", "model_config_id", "prompt")
    j = at.with_settings(a, fx.model_configs(spark, sf_dir))
    return j.select("event_id", at.request_payload("prompt", "settings").alias("payload"))


def _decoded_sql() -> str:
    body_v = "CASE WHEN json_valid(body) THEN body END"
    content = f"json_extract_string({body_v}, '$.choices[0].message.content')"
    keys = f"json_keys({body_v})"
    return f"""SELECT event_id,
      CASE WHEN transport_error = 'connection' THEN 'connection' WHEN transport_error = 'timeout' THEN 'timeout'
           WHEN status_code <> 200 THEN 'http_status' WHEN {body_v} IS NULL THEN 'non_json'
           WHEN {content} IS NULL THEN 'missing_content' END AS error_kind,
      CASE WHEN transport_error = 'connection' THEN 'Could not connect to llama-server at ' || server_url || ': connection'
           WHEN transport_error = 'timeout' THEN 'Request to llama-server timed out after 120s: timeout'
           WHEN status_code <> 200 THEN 'llama-server returned HTTP ' || CAST(status_code AS VARCHAR) || ': ' || coalesce(body, '')
           WHEN {body_v} IS NULL THEN 'llama-server returned non-JSON response: ' || substr(coalesce(body, ''), 1, 200)
           WHEN {content} IS NULL THEN 'Response JSON missing expected field ''choices[0].message.content'': available keys are ['
                || array_to_string(list_transform({keys}, lambda k: '''' || k || ''''), ', ') || ']' END AS error,
      CASE WHEN transport_error IS NULL AND status_code = 200 THEN {content} END AS response,
      CAST(json_extract({body_v}, '$.usage.total_tokens') AS BIGINT) AS total_tokens,
      CAST(printf('%.3f', latency_sec) AS DOUBLE) AS latency_sec
    FROM (SELECT c.*, s.server_url FROM ({fx.call_log_sql()}) c
          JOIN (SELECT event_id, 'model-' || CAST(user_id % 5 AS VARCHAR) AS model_config_id FROM events) u USING (event_id)
          JOIN ({fx.MODEL_SETTINGS_SQL}) s USING (model_config_id))"""


def decoded_calls(spark, sf_dir):
    """The call log decoded; each call's server URL is its model's (same rule as the config fixture)."""
    log = fx.call_log(spark, sf_dir)
    ev = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id", "'http://127.0.0.1:' || CAST(8080 + user_id % 5 AS STRING) || '/v1/chat/completions' AS server_url"
    )
    return rsp.decode_calls(log.join(ev, "event_id"))


@register("decode_responses", lambda: f"SELECT event_id, response, total_tokens, latency_sec FROM ({_decoded_sql()})")
def q_decode_responses(spark, sf_dir):
    d = decoded_calls(spark, sf_dir)
    return d.select("event_id", "response", F.col("usage")["total_tokens"].cast("bigint").alias("total_tokens"), "latency_sec")


@register("classify_failures", lambda: f"SELECT event_id, error_kind, error FROM ({_decoded_sql()})")
def q_classify_failures(spark, sf_dir):
    return decoded_calls(spark, sf_dir).select("event_id", "error_kind", "error")


_ATTEMPT_COLS = ["event_id", "run_id", "model_config_id", "task_id", "category", "task_file", "prompt", "expected",
                 "response", "latency_sec", "score", "passed", "reason"]


@register(
    "error_attempts",
    lambda: f"""SELECT a.event_id, run_id, model_config_id, task_id, category, task_file, prompt, expected_output AS expected,
        CASE WHEN d.error IS NOT NULL THEN '' ELSE a.response END AS response,
        CASE WHEN d.error IS NOT NULL THEN 0.0 ELSE a.latency_sec END AS latency_sec,
        CASE WHEN d.error IS NOT NULL THEN 0.0 ELSE a.score END AS score,
        CASE WHEN d.error IS NOT NULL THEN false ELSE a.passed END AS passed,
        CASE WHEN d.error IS NOT NULL THEN d.error ELSE a.reason END AS reason
        FROM ({orc.scored_all()}) a JOIN ({_decoded_sql()}) d USING (event_id)""",
)
def q_error_attempts(spark, sf_dir):
    scored = scored_attempts(spark, sf_dir)
    calls = decoded_calls(spark, sf_dir).select("event_id", "error")
    return at.attempt_rows(scored.join(calls, "event_id"), keep=("event_id",)).select(*_ATTEMPT_COLS)


@register(
    "expand_repeats",
    lambda: f"""SELECT task_file, line_no, id, CAST(unnest(range(0, 3)) AS INTEGER) AS repeat_index, 3 AS repeat_count
        FROM ({orc.scan_tasks_sql()})""",
)
def q_expand_repeats(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return pl.expand_repeats(tasks.select("task_file", "line_no", "id"), 3)


def _runs(spark, sf_dir):
    return fx.attempt_input(spark, sf_dir).select("model_config_id", "task_file").distinct()


@register(
    "run_plan",
    lambda: f"""WITH t AS ({orc.scan_tasks_sql()}), c AS (SELECT task_file, count(*) AS tasks FROM t GROUP BY task_file),
        r AS (SELECT DISTINCT model_config_id, task_file FROM ({fx.attempt_input_sql()}))
        SELECT r.model_config_id, r.task_file, t.line_no, '  ' || t.id || ': "' || t.description || '" -> ' || t.scorer AS line,
               CAST(c.tasks AS BIGINT) AS tasks, CAST(c.tasks * 3 AS BIGINT) AS total_attempts
        FROM r JOIN t USING (task_file) JOIN c USING (task_file)""",
)
def q_run_plan(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return pl.plan_lines(tasks, _runs(spark, sf_dir), 3).select(
        "model_config_id", "task_file", "line_no", "line", "tasks", "total_attempts"
    )


def _attempt_keys_sql() -> str:
    return f"SELECT *, {fx.REPEAT_INDEX_SQL} AS repeat_index FROM ({orc.scored_all()})"


@register(
    "join_responses",
    lambda: f"""WITH r AS ({_attempt_keys_sql()}),
        p AS (SELECT run_id, model_config_id, task_file, task_id, CAST(unnest(range(0, 3)) AS INTEGER) AS repeat_index
              FROM (SELECT DISTINCT run_id, model_config_id, task_file, task_id FROM r))
        SELECT p.run_id, p.model_config_id, p.task_file, p.task_id, p.repeat_index, r.response,
               CASE WHEN r.event_id IS NULL THEN 'No response' END AS error
        FROM p LEFT JOIN r USING (run_id, model_config_id, task_file, task_id, repeat_index)""",
)
def q_join_responses(spark, sf_dir):
    responses = fx.attempt_input_with_repeats(spark, sf_dir).select(*at.ATTEMPT_KEYS, "response")
    planned = pl.expand_repeats(responses.select("run_id", "model_config_id", "task_file", "task_id").distinct(), 3).drop("repeat_count")
    j = at.join_responses(planned, responses)
    return j.select(*at.ATTEMPT_KEYS, "response", "error")


@register(
    "attempts",
    lambda: f"""WITH r AS ({_attempt_keys_sql()})
        SELECT r.event_id, run_id, model_config_id, task_id, category, task_file, prompt, expected_output AS expected, response,
               latency_sec, score, passed, reason, s.context_size, s.temperature, s.top_p, s.max_tokens, repeat_index,
               CAST(count(*) OVER (PARTITION BY run_id, model_config_id, task_file, task_id) AS INTEGER) AS repeat_count
        FROM r LEFT JOIN ({fx.MODEL_SETTINGS_SQL}) s USING (model_config_id)""",
)
def q_attempts(spark, sf_dir):
    keys = ["run_id", "model_config_id", "task_file", "task_id"]
    inp = fx.attempt_input_with_repeats(spark, sf_dir)
    counts = inp.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("repeat_count"))
    scored = sc.score_frame(sc.with_task_spec(inp.join(counts, keys), task="task"), response="response", spec="spec")
    scored = scored.select("*", F.col("result.score").alias("score"), F.col("result.passed").alias("passed"),
                           F.col("result.reason").alias("reason"))
    rows = at.attempt_rows(at.with_settings(scored, fx.model_configs(spark, sf_dir)), keep=("event_id",))
    return rows.select(*_ATTEMPT_COLS, *[F.col(f"settings.{f}").alias(f) for f in at.SETTINGS_FIELDS], "repeat_index", "repeat_count")


@register(
    "attempt_ordinal",
    lambda: f"""WITH r AS ({_attempt_keys_sql()})
        SELECT event_id,
          CAST(row_number() OVER (PARTITION BY run_id, model_config_id, task_file ORDER BY task_id, repeat_index) AS BIGINT) AS ordinal,
          CAST(count(*) OVER (PARTITION BY run_id, model_config_id, task_file) AS BIGINT) AS total
        FROM r""",
)
def q_attempt_ordinal(spark, sf_dir):
    a = fx.attempt_input_with_repeats(spark, sf_dir).select("event_id", "run_id", "model_config_id", "task_file", "task_id", "repeat_index")
    o = pl.attempt_ordinals(a, ["run_id", "model_config_id", "task_file"], ["task_id", "repeat_index"], bucket=F.col("task_id"))
    return o.select("event_id", "ordinal", "total")


@register(
    "raw_output_path",
    lambda: f"""SELECT DISTINCT run_id, model_config_id, task_file,
        'results/raw/' || model_config_id || '/' || regexp_extract(task_file, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) || '_' || run_id || '.jsonl'
          AS raw_path FROM ({fx.attempt_input_sql()})""",
)
def q_raw_output_path(spark, sf_dir):
    from evalgrid.sinks.files import raw_results_path

    a = fx.attempt_input(spark, sf_dir).select("run_id", "model_config_id", "task_file").distinct()
    return a.withColumn("raw_path", raw_results_path("model_config_id", "task_file", "run_id"))


@register(
    "max_tasks",
    lambda: f"""SELECT task_file, line_no, id FROM (SELECT *, row_number() OVER (PARTITION BY task_file ORDER BY line_no) AS rn
        FROM ({orc.scan_tasks_sql()})) WHERE rn <= 25""",
)
def q_max_tasks(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return pl.first_n_tasks(tasks.select("task_file", "line_no", "id"), 25)


@register(
    "resume_missing_attempts",
    lambda: f"""SELECT p.* FROM ({fx.BENCH_PLAN_SQL}) p
        WHERE NOT EXISTS (SELECT 1 FROM ({fx.BENCH_COMPLETED_SQL}) c WHERE c.task_id = p.task_id AND c.repeat_index = p.repeat_index)""",
)
def q_resume_missing_attempts(spark, sf_dir):
    return pl.missing_attempts(fx.bench_plan(spark, sf_dir), fx.bench_completed(spark, sf_dir), ["task_id", "repeat_index"])


# ---------------------------------------------------------------------------
# Files written by Spark and read back: task files, summary CSVs
# ---------------------------------------------------------------------------

import hashlib  # noqa: E402

from evalgrid.session import scratch_path  # noqa: E402
from evalgrid.sinks import files as sinks  # noqa: E402


def _scratch(spark, sf_dir: str, name: str) -> str:
    return scratch_path(spark, "fixtures", hashlib.sha1(sf_dir.encode()).hexdigest()[:12], name)


def write_task_files(spark, sf_dir: str) -> str:
    """The fixture's task lines as JSONL files, one file per task file, lines in order."""
    path = _scratch(spark, sf_dir, "task_files")
    lines = fx.task_lines(spark, sf_dir)
    (
        lines.repartition("task_file").sortWithinPartitions("task_file", "line_no")
        .select("task_file", "line").write.mode("overwrite").partitionBy("task_file").text(path)
    )
    return path


@register("task_line_numbers", lambda: f"SELECT task_file, CAST(line_no AS BIGINT) AS line_no, line FROM ({fx.task_lines_sql()})")
def q_task_line_numbers(spark, sf_dir):
    return src_tasks.scan_lines(spark, write_task_files(spark, sf_dir), name_col="task_file")


def write_summary_csv(spark, sf_dir: str, old_before: str | None = None) -> list[str]:
    """The fixture's run summaries as CSV text files (the persisted form).

    With ``old_before`` (a run_id), runs before it are written with the old
    header (no total_attempts, repeats) into a second directory.
    """
    formatted = sm.format_summary(summary_of_fixture(spark, sf_dir))
    if old_before is None:
        p = _scratch(spark, sf_dir, "summary_csv")
        formatted.write.mode("overwrite").option("header", True).csv(p)
        return [p]
    p_old = _scratch(spark, sf_dir, "summary_csv_old")
    p_new = _scratch(spark, sf_dir, "summary_csv_new")
    old = formatted.filter(F.col("run_id") < old_before).drop("total_attempts", "repeats")
    old.write.mode("overwrite").option("header", True).csv(p_old)
    formatted.filter(F.col("run_id") >= old_before).write.mode("overwrite").option("header", True).csv(p_new)
    return [p_old, p_new]


def _formatted_sql() -> str:
    return f"""SELECT run_id, model_config_id, task_file, total_tasks, total_attempts, passed, failed,
        printf('%.4f', pass_rate) AS pass_rate, printf('%.4f', average_score) AS average_score,
        printf('%.3f', average_latency_sec) AS average_latency_sec, repeats FROM ({orc.run_summary_sql()})"""


def _parsed_sql(old_before: str | None = None) -> str:
    old = f"run_id < '{old_before}'" if old_before else "false"
    return f"""SELECT run_id, model_config_id, task_file, total_tasks,
        CASE WHEN {old} THEN total_tasks ELSE total_attempts END AS total_attempts, passed, failed,
        CAST(pass_rate AS DOUBLE) AS pass_rate, CAST(average_score AS DOUBLE) AS average_score,
        CAST(average_latency_sec AS DOUBLE) AS average_latency_sec,
        CASE WHEN {old} THEN 1 ELSE repeats END AS repeats FROM ({_formatted_sql()})"""


OLD_FORMAT_BEFORE = "2024-01-15_run"


@register("summary_scan", _parsed_sql)
def q_summary_scan(spark, sf_dir):
    (p,) = write_summary_csv(spark, sf_dir)
    return lb.parse_summary_text(sinks.read_summary_csv(spark, p)).select(*sm.SUMMARY_COLUMNS)


@register(
    "summary_migration",
    lambda: f"""SELECT run_id, model_config_id, task_file, CAST(total_tasks AS VARCHAR) AS total_tasks,
        CASE WHEN run_id < '{OLD_FORMAT_BEFORE}' THEN NULL ELSE CAST(total_attempts AS VARCHAR) END AS total_attempts,
        CAST(passed AS VARCHAR) AS passed, CAST(failed AS VARCHAR) AS failed, pass_rate, average_score, average_latency_sec,
        CASE WHEN run_id < '{OLD_FORMAT_BEFORE}' THEN NULL ELSE CAST(repeats AS VARCHAR) END AS repeats FROM ({_formatted_sql()})""",
)
def q_summary_migration(spark, sf_dir):
    paths = write_summary_csv(spark, sf_dir, OLD_FORMAT_BEFORE)
    return lb.migrate_summary_frames([sinks.read_summary_csv(spark, p) for p in paths]).drop("__seq")


@register("leaderboard_old_format", lambda: orc.latest_sql(_parsed_sql(OLD_FORMAT_BEFORE)))
def q_leaderboard_old_format(spark, sf_dir):
    paths = write_summary_csv(spark, sf_dir, OLD_FORMAT_BEFORE)
    merged = lb.migrate_summary_frames([sinks.read_summary_csv(spark, p) for p in paths])
    return lb.leaderboard(lb.parse_summary_text(merged))


@register(
    "run_summary_empty",
    lambda: f"""SELECT * FROM ({orc.run_summary_sql()}) UNION ALL
        SELECT DISTINCT run_id, model_config_id, 'tasks/empty.jsonl', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
               CAST(0 AS BIGINT), 0.0, 0.0, 0.0, 1 FROM ({fx.attempt_input_sql()})""",
)
def q_run_summary_empty(spark, sf_dir):
    scored = scored_attempts(spark, sf_dir)
    planned = scored.select("run_id", "model_config_id", "task_file").distinct().unionByName(
        scored.select("run_id", "model_config_id", F.lit("tasks/empty.jsonl").alias("task_file")).distinct()
    )
    return sm.summary_for_planned_runs(scored, planned)


# ---------------------------------------------------------------------------
# Long texts: documents and conversations as responses
# ---------------------------------------------------------------------------

_DOC_KW = "['the', 'ment', 'data', lang, source]"


@register(
    "score_doc_keywords",
    lambda: "SELECT doc_id, quality, toxic, " + ", ".join(
        f"{e} AS {n}" for e, n in zip(orc.keyword_sql(f"({_DOC_KW.replace('[', 'list_value(').replace(']', ')')})"), ("score", "passed", "reason"))
    ) + f" FROM ({fx.DOC_KEYWORDS_SQL})",
)
def q_score_doc_keywords(spark, sf_dir):
    d = fx.doc_keywords(spark, sf_dir).withColumn(
        "task", F.expr("to_variant_object(named_struct('expected_keywords', array('the', 'ment', 'data', lang, source)))")
    )
    out = sc.score_tasks(d, task="task", response="response", scorer="keyword_match", out="r")
    return out.select("doc_id", "quality", "toxic", F.col("r.score").alias("score"), F.col("r.passed").alias("passed"),
                      F.col("r.reason").alias("reason"))


@register(
    "score_chat_pairs",
    lambda: "SELECT conv_id, turn, " + ", ".join(
        f"{e} AS {n}" for e, n in zip(orc.keyword_sql("list_filter(string_split(prompt, ' '), lambda w: length(w) > 3)"),
                                      ("score", "passed", "reason"))
    ) + f" FROM ({fx.CHAT_PAIRS_SQL})",
)
def q_score_chat_pairs(spark, sf_dir):
    p = fx.chat_pairs(spark, sf_dir).withColumn(
        "task", F.expr("to_variant_object(named_struct('expected_keywords', filter(split(prompt, ' '), w -> length(w) > 3)))")
    )
    out = sc.score_tasks(p, task="task", response="response", scorer="keyword_match", out="r")
    return out.select("conv_id", "turn", F.col("r.score").alias("score"), F.col("r.passed").alias("passed"),
                      F.col("r.reason").alias("reason"))


# ---------------------------------------------------------------------------
# Suites, manifests, run reports (specified follow-on operators)
# ---------------------------------------------------------------------------

from evalgrid.operators import importers as imp  # noqa: E402
from evalgrid.operators import manifests as mf  # noqa: E402
from evalgrid.operators import runs as rn  # noqa: E402

_RUN_KEYS = ["run_id", "model_config_id", "task_file"]


@register(
    "tasks_by_suite",
    lambda: f"SELECT s.suite_id, t.task_file, t.line_no, t.id FROM ({orc.scan_tasks_sql()}) t JOIN ({fx.SUITES_SQL}) s USING (task_file)",
)
def q_tasks_by_suite(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return rn.tasks_by_suite(tasks, fx.suites(spark, sf_dir)).select("suite_id", "task_file", "line_no", "id")


@register(
    "suites_missing_tasks",
    lambda: f"""SELECT suite_id, name, task_file FROM ({fx.SUITES_SQL}) s
        WHERE NOT EXISTS (SELECT 1 FROM ({orc.scan_tasks_sql()}) t WHERE t.task_file = s.task_file)""",
)
def q_suites_missing_tasks(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    return rn.suites_without_tasks(fx.suites(spark, sf_dir), tasks).select("suite_id", "name", "task_file")


def _status_sql() -> str:
    return f"""SELECT run_id, model_config_id, task_file, arg_max(status, (ts, event_id)) AS status,
        min(ts) AS started_at, CASE WHEN arg_max(status, (ts, event_id)) <> 'running' THEN max(ts) END AS finished_at FROM ({fx.status_events_sql()}) GROUP BY run_id, model_config_id, task_file"""


def _status(spark, sf_dir):
    return rn.latest_status(fx.status_events(spark, sf_dir), _RUN_KEYS, "ts", "event_id")


@register("run_status_latest", _status_sql)
def q_run_status_latest(spark, sf_dir):
    return _status(spark, sf_dir)


def _artifacts_sql() -> str:
    return f"""SELECT run_id, model_config_id, task_file, event_id,
        'artifacts/suite-' || regexp_extract(task_file, 'tasks/(.*)\\.jsonl', 1) || '/'
        || regexp_replace(task_id || ':' || model_config_id || ' ' || run_id, '[^A-Za-z0-9._-]', '_', 'g') || '_response.md' AS artifact_path,
        response FROM ({fx.attempt_input_sql()}) WHERE category IN ('code', 'coding')"""


def _artifacts(spark, sf_dir):
    a = fx.attempt_input(spark, sf_dir).withColumns({
        "suite_id": F.concat(F.lit("suite-"), F.regexp_extract("task_file", r"tasks/(.*)\.jsonl", 1)),
        "artifact_key": F.concat_ws(" ", F.concat_ws(":", "task_id", "model_config_id"), "run_id"),
    })
    return rn.artifact_rows(a, "suite_id", "artifact_key")


@register("artifact_paths", _artifacts_sql)
def q_artifact_paths(spark, sf_dir):
    return _artifacts(spark, sf_dir).select("run_id", "model_config_id", "task_file", "event_id", "artifact_path", "response")


def _full_sql() -> str:
    return f"""SELECT s.*, coalesce(st.status, 'unknown') AS status, st.started_at, st.finished_at, su.suite_id,
        CAST(coalesce(ac.n, 0) AS BIGINT) AS artifact_count
        FROM ({orc.run_summary_sql()}) s
        LEFT JOIN ({_status_sql()}) st USING (run_id, model_config_id, task_file)
        LEFT JOIN ({fx.SUITES_SQL}) su USING (task_file)
        LEFT JOIN (SELECT run_id, model_config_id, task_file, count(*) AS n FROM ({_artifacts_sql()}) GROUP BY ALL) ac
          USING (run_id, model_config_id, task_file)"""


@register("run_summary_full", _full_sql)
def q_run_summary_full(spark, sf_dir):
    full = rn.full_summary(summary_of_fixture(spark, sf_dir), _status(spark, sf_dir), fx.suites(spark, sf_dir), _artifacts(spark, sf_dir))
    return full.drop("name") if "name" in full.columns else full


@register(
    "leaderboard_by_suite",
    lambda: f"""SELECT *, rank() OVER (PARTITION BY suite_id ORDER BY average_score DESC, pass_rate DESC, average_latency_sec ASC,
            model_config_id, task_file) AS rank
        FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_config_id, suite_id ORDER BY run_id DESC) AS rn
              FROM (SELECT s.*, su.suite_id FROM ({orc.run_summary_sql()}) s JOIN ({fx.SUITES_SQL}) su USING (task_file))) WHERE rn = 1)""",
)
def q_leaderboard_by_suite(spark, sf_dir):
    s = summary_of_fixture(spark, sf_dir).join(fx.suites(spark, sf_dir).select("suite_id", "task_file"), "task_file")
    return rn.suite_leaderboard(s)


# Manifests as a run folder has them: one model's were saved under an older run id, so its summaries have
# none and its manifests no summary.
_MOVED = "CASE WHEN model_config_id = 'model-4' THEN 'old-' || run_id ELSE run_id END"


def _manifest_sql() -> str:
    return f"SELECT * REPLACE ({_MOVED} AS run_id) FROM ({_status_sql()})"


def _manifests(spark, sf_dir):
    return _status(spark, sf_dir).withColumn("run_id", F.expr(_MOVED))


@register(
    "runs_overview",
    lambda: f"""SELECT coalesce(s.run_id, st.run_id) AS run_id, coalesce(s.model_config_id, st.model_config_id) AS model_config_id,
        coalesce(s.task_file, st.task_file) AS task_file, coalesce(st.status, 'unknown') AS status,
        s.average_score, s.pass_rate, s.average_latency_sec, st.started_at
        FROM ({orc.run_summary_sql()}) s FULL OUTER JOIN ({_manifest_sql()}) st USING (run_id, model_config_id, task_file)""",
)
def q_runs_overview(spark, sf_dir):
    o = rn.runs_overview(summary_of_fixture(spark, sf_dir), _manifests(spark, sf_dir), _RUN_KEYS)
    return o.select(*_RUN_KEYS, "status", "average_score", "pass_rate", "average_latency_sec", "started_at")


# Runs by what their manifests say, whole or damaged.


def _run_manifests_sql() -> str:
    last = ", ".join(f"arg_max({f}, (ts, event_id)) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in mf.MANIFEST_FIELDS)
    said = "FILTER (WHERE status IN ('running', 'completed', 'cancelled', 'failed'))"
    return f"""SELECT * REPLACE (coalesce(status, 'unknown') AS status),
          CASE WHEN status <> 'running' THEN status_ts END AS completed_at,
          coalesce(status = 'running' AND last_event_at < TIMESTAMP '2024-01-29 18:00:00', false) AS silent
        FROM (SELECT run_id, model_config_id, task_file, {last}, arg_max(status, (ts, event_id)) {said} AS status,
                arg_max(ts, (ts, event_id)) {said} AS status_ts, min(ts) AS started_at, max(ts) AS last_event_at
              FROM ({fx.select_sql(fx.MANIFEST_EVENTS, "events")}) GROUP BY run_id, model_config_id, task_file)"""


def _run_manifests(spark, sf_dir):
    as_of = datetime.datetime(2024, 1, 30)
    return mf.run_manifests(fx.manifest_events(spark, sf_dir), _RUN_KEYS, "ts", "event_id", as_of, datetime.timedelta(hours=6))


@register("run_manifests", lambda: f"SELECT * EXCLUDE (status_ts) FROM ({_run_manifests_sql()})")
def q_run_manifests(spark, sf_dir):
    return _run_manifests(spark, sf_dir)


_COUNTED_SQL = f"SELECT run_id, model_config_id, task_file, CAST(count(*) AS BIGINT) AS n FROM ({_artifacts_sql()}) GROUP BY ALL"


@register(
    "run_report",
    lambda: f"""SELECT s.run_id, s.model_config_id, m.model_name, m.suite_id, m.suite_name, s.task_file,
        'results/runs/' || s.model_config_id || '/' || s.run_id AS run_folder, coalesce(m.status, 'unknown') AS status,
        s.total_tasks, s.total_attempts, s.passed, s.failed, s.pass_rate, s.average_score, s.average_latency_sec, s.repeats,
        coalesce(c.n, 0) AS artifact_count, m.started_at, m.completed_at
        FROM ({orc.run_summary_sql()}) s LEFT JOIN ({_run_manifests_sql()}) m USING (run_id, model_config_id, task_file)
        LEFT JOIN ({_COUNTED_SQL}) c USING (run_id, model_config_id, task_file)""",
)
def q_run_report(spark, sf_dir):
    return mf.run_report(summary_of_fixture(spark, sf_dir), _run_manifests(spark, sf_dir), _artifacts(spark, sf_dir))


@register(
    "runs_listing",
    lambda: f"""SELECT model_config_id, run_id, task_file, m.suite_id, coalesce(m.status, 'unknown') AS status,
        s.average_score, s.pass_rate, s.average_latency_sec, coalesce(c.n, 0) AS artifact_count
        FROM ({orc.run_summary_sql()}) s
        FULL OUTER JOIN (SELECT * REPLACE ({_MOVED} AS run_id) FROM ({_run_manifests_sql()})) m USING (run_id, model_config_id, task_file)
        LEFT JOIN ({_COUNTED_SQL}) c USING (run_id, model_config_id, task_file)""",
)
def q_runs_listing(spark, sf_dir):
    saved = _run_manifests(spark, sf_dir).withColumn("run_id", F.expr(_MOVED))
    return mf.runs_listing(summary_of_fixture(spark, sf_dir), saved, _artifacts(spark, sf_dir))


@register(
    "manifest_documents",
    lambda: f"""SELECT path, CAST(event_id AS VARCHAR) || '_run' AS run_id, 'model-' || CAST(user_id % 5 AS VARCHAR) AS model_config_id,
        bad AS corrupt, CASE WHEN NOT bad THEN 'tasks/' || event_type || '.jsonl' END AS task_file,
        CASE WHEN NOT bad AND event_id % 3 = 0 THEN '{{"top_p":1}}' END AS settings,
        CASE WHEN NOT bad AND event_id % 4 <> 0 THEN CAST(user_id AS BIGINT) END AS repeats,
        CASE WHEN bad OR event_id % 5 = 0 THEN 'unknown' WHEN event_id % 5 = 1 THEN 'failed' ELSE 'completed' END AS status
        FROM (SELECT *, event_id % 11 < 4 AS bad FROM ({fx.select_sql(fx.MANIFEST_DOCUMENTS, "events")}))""",
)
def q_manifest_documents(spark, sf_dir):
    return mf.read_manifests(fx.manifest_documents(spark, sf_dir)).select(
        "path", "run_id", "model_config_id", "corrupt", "task_file", "settings", "repeats", "status"
    )


@register(
    "run_status_changes",
    lambda: f"""SELECT run_id, model_config_id, task_file, from_status, from_id, to_status, to_id FROM (
        SELECT run_id, model_config_id, task_file, lag(status) OVER w AS from_status, lag(event_id) OVER w AS from_id,
               status AS to_status, event_id AS to_id
        FROM ({fx.status_events_sql()}) WINDOW w AS (PARTITION BY run_id, model_config_id, task_file ORDER BY ts, event_id))
        WHERE from_status IS NOT NULL AND from_status <> to_status AND (from_status, to_status) NOT IN {tuple(mf.STATUS_CHANGES)}""",
)
def q_run_status_changes(spark, sf_dir):
    return qa.invalid_transitions(
        fx.status_events(spark, sf_dir), _RUN_KEYS, ["ts", "event_id"], ident="event_id", allowed=mf.STATUS_CHANGES
    )


@register("score_by_suite", orc.scored_by_suite)
def q_score_by_suite(spark, sf_dir):
    tasks = sc.with_task_spec(fx.attempt_input(spark, sf_dir), task="task")
    chosen = rn.with_suite_scorers(tasks, fx.scored_suites(spark, sf_dir), fx.scoring_rules(spark))
    return sc.score_frame(chosen).select(
        "suite_id", "event_id", F.col("spec_scorer").alias("scorer"), "result.score", "result.passed", "result.reason"
    )


@register(
    "raw_result_files",
    lambda: f"""SELECT model_config_id || '/' || regexp_extract(task_file, 'tasks/(.*)\\.jsonl', 1) || '_' || run_id || '.jsonl' AS file,
        CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE NOT whole) AS BIGINT) AS corrupt_lines,
        CAST(count(*) FILTER (WHERE whole) AS BIGINT) AS completed_attempts, CAST(max(upto) AS BIGINT) AS size_bytes,
        CAST(coalesce(max(upto) FILTER (WHERE whole), 0) AS BIGINT) AS good_bytes,
        coalesce(max(upto) FILTER (WHERE whole), 0) < max(upto) AS torn
        FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY run_id, model_config_id, task_file ORDER BY event_id) AS upto
              FROM ({fx.select_sql(fx.RAW_LINES, "events")})) GROUP BY run_id, model_config_id, task_file""",
)
def q_raw_result_files(spark, sf_dir):
    from evalgrid.session import scratch_path
    from evalgrid.sinks import rawfiles

    root = scratch_path(spark, f"raw-{uuid.uuid4().hex}", "results", "raw")
    rawfiles.write_raw_files(fx.raw_lines(spark, sf_dir), root, order=["event_id"], line="line")
    return rawfiles.raw_file_report(rawfiles.raw_line_index(spark, root))


@register(
    "response_consistency",
    lambda: f"""SELECT run_id, model_config_id, task_file, task_id, CAST(count(*) AS BIGINT) AS attempts,
        CAST(count(DISTINCT response) AS BIGINT) AS unique_responses FROM ({fx.attempt_input_sql()}) GROUP BY ALL""",
)
def q_response_consistency(spark, sf_dir):
    return rn.response_consistency(fx.attempt_input(spark, sf_dir), _RUN_KEYS + ["task_id"])


@register(
    "partial_summary",
    lambda: f"""SELECT s.*, p.planned_attempts, CAST(s.total_attempts AS DOUBLE) / p.planned_attempts AS completion_ratio
        FROM ({orc.run_summary_sql(f"SELECT * FROM ({orc.scored_all()}) WHERE latency_sec <= 2.0")}) s
        JOIN (SELECT run_id, model_config_id, task_file, CAST(count(*) AS BIGINT) AS planned_attempts
              FROM ({fx.attempt_input_sql()}) GROUP BY ALL) p USING (run_id, model_config_id, task_file)""",
)
def q_partial_summary(spark, sf_dir):
    scored = scored_attempts(spark, sf_dir)
    return sm.partial_summary(scored.filter(F.col("latency_sec") <= 2.0), scored)


def _raw_lines(spark, sf_dir):
    a = scored_attempts(spark, sf_dir)
    js = F.to_json(F.struct("run_id", "model_config_id", "task_id", "response", "score", "passed", "reason"))
    cut = F.expr("substr(to_json(named_struct('run_id', run_id, 'model_config_id', model_config_id, 'task_id', task_id, "
                 "'response', response, 'score', score, 'passed', passed, 'reason', reason)), 1, 40)")
    return a.select("event_id", "model_config_id", F.when(F.col("latency_sec") > 4.5, cut).otherwise(js).alias("line"))


@register(
    "raw_corrupt_lines",
    lambda: f"""SELECT model_config_id, CAST(count(*) AS BIGINT) AS lines,
        CAST(count(*) FILTER (WHERE latency_sec > 4.5) AS BIGINT) AS corrupt_lines,
        CAST(count(*) FILTER (WHERE latency_sec <= 4.5) AS BIGINT) AS completed_attempts
        FROM ({fx.attempt_input_sql()}) GROUP BY model_config_id""",
)
def q_raw_corrupt_lines(spark, sf_dir):
    return rn.raw_line_report(_raw_lines(spark, sf_dir), ["model_config_id"])


@register(
    "prompt_size",
    lambda: f"""SELECT doc_id, CAST(length(response) AS BIGINT) AS chars,
        CAST(len(list_filter(regexp_split_to_array(response, '{orc._WS}+'), lambda w: w <> '')) AS INTEGER) AS words,
        CAST(ceil(length(response) / 4.0) AS BIGINT) AS estimated_context_tokens FROM ({fx.DOC_KEYWORDS_SQL})""",
)
def q_prompt_size(spark, sf_dir):
    from evalgrid.operators.quality import prompt_size

    return prompt_size(fx.doc_keywords(spark, sf_dir), "response", ["doc_id"])


def _imported(spark, sf_dir):
    g = imp.import_gsm8k(fx.bench_source(spark, sf_dir, fx.GSM8K_SRC))
    m = imp.import_multiple_choice(fx.bench_source(spark, sf_dir, fx.MC_SRC))
    c = imp.import_code(fx.bench_source(spark, sf_dir, fx.CODE_SRC))
    return g.unionByName(m).unionByName(c)


@register(
    "import_qa_tasks",
    lambda: """SELECT 'gsm8k-' || CAST(item_id AS VARCHAR) AS id, text AS description, CAST(length(text) AS VARCHAR) AS expected_output,
            'math' AS category, 'gsm8k' AS source, true AS valid FROM benchmark
        UNION ALL
        SELECT 'mmlu-' || CAST(item_id AS VARCHAR), 'Which clause comes first in item ' || CAST(item_id AS VARCHAR) || '?' || chr(10)
            || array_to_string(list_transform(string_split(text, ', '), lambda c, i: chr(CAST(64 + i AS INTEGER)) || '. ' || c), chr(10)),
            'A', 'text', 'mmlu', true FROM benchmark
        UNION ALL
        SELECT 'humaneval-' || CAST(item_id AS VARCHAR), 'def solve_' || CAST(item_id AS VARCHAR) || '():' || chr(10) || '    # ' || text,
            'solve_' || CAST(item_id AS VARCHAR), 'code', 'humaneval', true FROM benchmark""",
)
def q_import_qa_tasks(spark, sf_dir):
    tasks = _imported(spark, sf_dir)
    lines = imp.as_task_lines(tasks).withColumn("task_file", F.concat(F.lit("imported/"), F.col("source"), F.lit(".jsonl")))
    parsed, errors = src_tasks.parse_task_lines(lines.drop("source"))
    valid = parsed.select(F.col("id").alias("__vid"), F.lit(True).alias("valid"))
    return tasks.join(valid, tasks.id == valid.__vid, "left").select(
        "id", "description", "expected_output", "category", "source", F.coalesce("valid", F.lit(False)).alias("valid")
    )


# ---------------------------------------------------------------------------
# Documented work-item rules (data-quality jobs)
# ---------------------------------------------------------------------------

from evalgrid.operators import quality as qa  # noqa: E402

_TYPES_IN = "(" + ", ".join(f"'{t}'" for t in qa.TYPES) + ")"
_STATUS_IN = "(" + ", ".join(f"'{t}'" for t in qa.STATUSES) + ")"


def _violations_sql() -> str:
    dt = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
    parts = [
        ("id_format", "NOT regexp_full_match(id, '^[a-zA-Z0-9_-]+$') OR length(id) > 100", "'invalid id: ' || id"),
        ("type_enum", f"type IS NULL OR type NOT IN {_TYPES_IN}", "'invalid type: ' || coalesce(type, 'null')"),
        ("priority_range", "priority IS NULL OR priority < 1 OR priority > 5", "'priority out of range: ' || coalesce(CAST(priority AS VARCHAR), 'null')"),
        ("status_enum", f"status IS NULL OR status NOT IN {_STATUS_IN}", "'invalid status: ' || coalesce(status, 'null')"),
        ("due_date_format", f"NOT regexp_full_match(due_date, '{dt}') OR try_strptime(due_date, '%Y-%m-%dT%H:%M:%SZ') IS NULL",
         "'invalid due_date: ' || due_date"),
        ("hours_range", "estimated_hours IS NOT NULL AND (estimated_hours < 0.1 OR estimated_hours > 999.99)",
         "'estimated_hours out of range: ' || CAST(estimated_hours AS VARCHAR)"),
        ("hours_precision", "estimated_hours IS NOT NULL AND CAST(estimated_hours AS DECIMAL(20,2)) <> CAST(estimated_hours AS DECIMAL(24,10))",
         "'estimated_hours has more than 2 decimals: ' || CAST(estimated_hours AS VARCHAR)"),
        ("description_length", "length(description) > 10000 AND description IS NOT NULL",
         "'description longer than 10000 characters: ' || CAST(length(description) AS VARCHAR)"),
        ("description_newline", "description IS NOT NULL AND contains(description, chr(10))", "'description contains a newline'"),
        ("assignee_length", "length(assignee) > 100 AND assignee IS NOT NULL",
         "'assignee longer than 100 characters: ' || CAST(length(assignee) AS VARCHAR)"),
    ]
    return " UNION ALL ".join(
        f"SELECT id, '{name}' AS rule, {msg} AS message FROM ({fx.work_items_full_sql()}) WHERE coalesce({pred}, {'false' if name.endswith(('_length', '_newline')) else 'true'})"
        for name, pred, msg in parts
    )


@register("rule_violations", _violations_sql)
def q_rule_violations(spark, sf_dir):
    return qa.rule_violations(fx.work_items_full(spark, sf_dir))


@register(
    "duplicate_ids",
    lambda: f"""SELECT task_file, json_extract_string(j, '$.id') AS id, CAST(count(*) AS BIGINT) AS occurrences,
        CAST(min(line_no) AS BIGINT) AS first_line FROM ({orc.checked_lines_sql()})
        WHERE id_k IN ('str', 'int') GROUP BY task_file, json_extract_string(j, '$.id') HAVING count(*) > 1""",
)
def q_duplicate_ids(spark, sf_dir):
    c = src_tasks._checked(fx.task_lines(spark, sf_dir)).filter(F.col("__id_k").isin("str", "int"))
    return qa.duplicate_keys(c.select("task_file", F.col("__id_text").alias("id"), "line_no"), ["task_file", "id"])


@register(
    "dangling_dependencies",
    lambda: f"""SELECT w.* FROM ({fx.work_items_full_sql()}) w
        WHERE depends_on IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({fx.work_items_full_sql()}) k WHERE k.id = w.depends_on)""",
)
def q_dangling_dependencies(spark, sf_dir):
    return qa.dangling_references(fx.work_items_full(spark, sf_dir), "depends_on")


@register(
    "invalid_transitions",
    lambda: f"""SELECT o_custkey, from_status, from_id, to_status, to_id FROM (
        SELECT o_custkey, lag(status) OVER w AS from_status, lag(id) OVER w AS from_id, status AS to_status, id AS to_id
        FROM ({fx.work_items_full_sql()}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        WHERE from_status IS NOT NULL AND from_status <> to_status
          AND (from_status, to_status) NOT IN {tuple(qa.ALLOWED_TRANSITIONS)}""",
)
def q_invalid_transitions(spark, sf_dir):
    return qa.invalid_transitions(fx.work_items_full(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "from_status", "from_id", "to_status", "to_id"
    )


@register(
    "apply_defaults",
    lambda: f"""SELECT task_file, line_no,
        CAST(coalesce(TRY_CAST(json_extract(j, '$.priority') AS INTEGER), 3) AS INTEGER) AS priority,
        coalesce(json_extract_string(j, '$.status'), 'pending') AS status,
        CAST(coalesce(json_array_length(j, '$.dependencies'), 0) AS INTEGER) AS n_dependencies,
        coalesce(CAST(json_extract(j, '$.metadata') AS VARCHAR), '{{}}') AS metadata
        FROM ({orc.checked_lines_sql()}) WHERE json_type(j) = 'OBJECT'""",
)
def q_apply_defaults(spark, sf_dir):
    c = src_tasks._checked(fx.task_lines(spark, sf_dir)).filter(F.col("__kind") == "dict")
    return qa.apply_defaults(c, "raw", ["task_file", "line_no"])


@register(
    "enrich_tasks",
    lambda: f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(response, '{orc._WS}+'), lambda w: w <> '')) AS INTEGER) AS word_count,
        d.source = 'src0' AS has_dependencies FROM ({fx.DOC_KEYWORDS_SQL}) JOIN documents d USING (doc_id)""",
)
def q_enrich_tasks(spark, sf_dir):
    # documents of one source build on that source, the others on nothing
    sources = fx.table(spark, sf_dir, "documents").select("doc_id", F.filter(F.array("source"), lambda s: s == "src0").alias("dependencies"))
    return qa.enrich(fx.doc_keywords(spark, sf_dir).join(sources, "doc_id"), "response", "dependencies", ["doc_id"])


@register(
    "migrate_legacy",
    lambda: f"""SELECT id, CASE WHEN o_custkey % 4 = 0 THEN 'other' ELSE type END AS type,
        CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE priority END AS priority,
        CASE WHEN o_custkey % 6 = 0 THEN 'pending' ELSE status END AS status, description,
        CASE WHEN o_custkey % 7 = 0 THEN '' ELSE assignee END AS assignee, due_date, 'old_format' AS legacy_source
        FROM ({fx.work_items_full_sql()})""",
)
def q_migrate_legacy(spark, sf_dir):
    legacy = fx.work_items_full(spark, sf_dir).select(F.parse_json(F.expr(fx.LEGACY_JSON_SQL)).alias("v"))
    return qa.migrate_legacy(legacy, "v").drop("metadata")


@register(
    "upsert_tasks",
    lambda: f"""WITH b AS (SELECT id, status, description, 'base' AS origin FROM ({fx.work_items_full_sql()})),
        n AS (SELECT id, 'completed' AS status, description || ' (closed)' AS description, 'update' AS origin
              FROM ({fx.work_items_full_sql()}) WHERE o_totalprice > 200000)
        SELECT * FROM b WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""",
)
def q_upsert_tasks(spark, sf_dir):
    w = fx.work_items_full(spark, sf_dir)
    base = w.select("id", "status", "description", F.lit("base").alias("origin"))
    new = w.filter(F.col("o_totalprice") > 200000).select(
        "id", F.lit("completed").alias("status"), F.concat("description", F.lit(" (closed)")).alias("description"),
        F.lit("update").alias("origin"),
    )
    return qa.upsert(base, new)


@register(
    "load_metrics",
    lambda: f"""SELECT task_file, CAST(count(*) FILTER (WHERE error_type IS NULL) AS BIGINT) AS loaded,
        CAST(count(*) FILTER (WHERE error_type IS NOT NULL) AS BIGINT) AS errors,
        count(*) FILTER (WHERE error_type IS NOT NULL) = 0 AS success FROM ({orc.checked_lines_sql()}) GROUP BY task_file""",
)
def q_load_metrics(spark, sf_dir):
    return src_tasks.load_metrics(fx.task_lines(spark, sf_dir))


# ---------------------------------------------------------------------------
# Streaming ingest and batch generation
# ---------------------------------------------------------------------------

import uuid  # noqa: E402

from evalgrid.streaming import attempts as stream_attempts  # noqa: E402


@register("stream_running_summary", orc.run_summary_sql)
def q_stream_running_summary(spark, sf_dir):
    """Scored attempts written as JSONL files per run, ingested by the stream
    (availableNow), summarised from the stream's state updates."""
    return stream_attempts.current_summary(spark, _streamed(spark, sf_dir))


def _streamed(spark, sf_dir) -> str:
    """The folder into which the scored attempts have been streamed."""
    base = _scratch(spark, sf_dir, f"stream-{uuid.uuid4().hex[:8]}")
    src, upd, ckpt = f"{base}/attempts", f"{base}/updates", f"{base}/checkpoint"
    inp = fx.attempt_input_with_repeats(spark, sf_dir)
    scored = sc.score_frame(sc.with_task_spec(inp, task="task"), response="response", spec="spec").select(
        "event_id", "model_config_id", "task_file", "task_id", "repeat_index",
        F.col("result.score").alias("score"), F.col("result.passed").alias("passed"), "latency_sec", "run_id",
        "category", "prompt", "response", F.col("result.reason").alias("reason"),
    )
    scored.hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").json(src)
    q = stream_attempts.start_running_summary(spark, src, upd, ckpt, available_now=True, max_files_per_trigger=16)
    q.awaitTermination()
    return upd


@register(
    "stream_attempts",
    lambda: f"""SELECT event_id, run_id, model_config_id, task_file, task_id, response, score, passed, reason, latency_sec
        FROM ({orc.scored_all()})""",
)
def q_stream_attempts(spark, sf_dir):
    """The attempts that the stream has stored, whole."""
    rows = stream_attempts.stored_attempts(spark, _streamed(spark, sf_dir))
    return rows.select("event_id", "run_id", "model_config_id", "task_file", "task_id", "response", "score", "passed", "reason", "latency_sec")


from evalgrid.operators import generate as gen  # noqa: E402


@register(
    "batch_generate",
    lambda: f"""SELECT event_id, prompt, CASE WHEN contains(prompt, '7') THEN NULL ELSE 'ANSWER: ' || upper(prompt) END AS response,
        CASE WHEN contains(prompt, '7') THEN 'generation failed for prompt of ' || CAST(length(prompt) AS VARCHAR) || ' chars' END AS error
        FROM ({fx.attempt_input_sql()})""",
)
def q_batch_generate(spark, sf_dir):
    plan = fx.attempt_input(spark, sf_dir).select("event_id", "prompt")
    return gen.batch_generate(plan, gen.echo_generator, keep=["event_id"]).select("event_id", "prompt", "response", "error")


# ---------------------------------------------------------------------------
# Task files + logged calls, end to end: spec once per task, then join
# ---------------------------------------------------------------------------

from evalgrid.operators import evaluate as ev  # noqa: E402


def _evaluate_sql() -> str:
    resp = f"""SELECT d.event_id, 'tasks/' || e.event_type || '.jsonl' AS task_file, CAST(d.event_id AS VARCHAR) AS id,
                 d.response, d.error FROM ({_decoded_sql()}) d JOIN events e USING (event_id)"""
    e, r = orc.strip("t.expected_output"), orc.strip("r.response")
    ok = f"(t.id IS NOT NULL AND r.error IS NULL AND r.response IS NOT NULL AND lower({e}) = lower({r}))"
    return f"""SELECT r.event_id, r.task_file, r.id, t.scorer,
        CASE WHEN {ok} THEN 1.0 ELSE 0.0 END AS score, {ok} AS passed,
        CASE WHEN t.id IS NULL THEN 'Unknown task' WHEN r.error IS NOT NULL THEN r.error
             WHEN r.response IS NULL THEN 'Response is None'
             WHEN {ok} THEN 'Matched expected answer'
             ELSE 'Expected ''' || {e} || ''' but got ''' || {r} || '''' END AS reason
        FROM ({resp}) r LEFT JOIN ({orc.scan_tasks_sql()}) t USING (task_file, id)"""


@register("evaluate_task_files", _evaluate_sql)
def q_evaluate_task_files(spark, sf_dir):
    tasks, _ = parsed_fixture(spark, sf_dir)
    calls = decoded_calls(spark, sf_dir).join(
        fx.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"
    )
    responses = calls.select(
        "event_id", F.concat(F.lit("tasks/"), F.col("event_type"), F.lit(".jsonl")).alias("task_file"),
        F.col("event_id").cast("string").alias("id"), "response", "error",
    )
    out = ev.evaluate_responses(responses, tasks)
    return out.select("event_id", "task_file", "id", "scorer", "score", "passed", "reason")
