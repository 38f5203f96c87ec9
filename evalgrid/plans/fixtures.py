"""Evaluation-shaped views over the driver's synthetic tables.

None of the given tables is an evaluation log, so the inputs are derived
deterministically: ``events`` become attempts (user -> model, type -> task
file, day -> run, value -> latency and numbers, props -> tool-call JSON),
``events`` also become task-file lines and logged model calls,
``conversations`` prompt/response pairs, ``documents`` long keyword
responses, ``benchmark`` a task plan, ``orders`` work items.

Each view is a list of ``(name, SQL expression)`` pairs over one base table.
The same expressions build the Spark DataFrame (``selectExpr``) and the
DuckDB oracle's CTE, so both engines start from identical rows; only SQL
that both dialects read the same way is used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators.sequence import row_number_within

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; in local mode spread over the cores (see ``session.spread``)."""
    from evalgrid.session import spread

    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def costly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` for views whose rows are scored, parsed or decoded: a few bytes a row, but tens of microseconds of work."""
    from evalgrid.session import deal

    return deal(table(spark, sf_dir, "events"), "event_id", "ts")


# --- v_attempt_input: tasks joined with responses, unscored ----------------

ATTEMPT_INPUT = [
    ("event_id", "event_id"),
    ("run_id", "CAST(CAST(ts AS DATE) AS STRING) || '_run'"),
    ("model_config_id", "'model-' || CAST(user_id % 5 AS STRING)"),
    ("task_file", "'tasks/' || event_type || '.jsonl'"),
    ("task_id", "'t' || CAST(event_id % 20 AS STRING)"),
    ("category", "CASE event_id % 9 WHEN 0 THEN 'math' WHEN 1 THEN 'numeric' WHEN 2 THEN 'text' "
                 "WHEN 3 THEN 'general' WHEN 4 THEN 'keyword' WHEN 5 THEN 'code' "
                 "WHEN 6 THEN 'json' WHEN 7 THEN 'tool' ELSE 'unmapped' END"),
    ("prompt", "'Describe event ' || CAST(event_id AS STRING)"),
    ("expected_output", "CASE WHEN event_id % 9 IN (0, 1) THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) "
                        "WHEN event_id % 9 IN (6, 7) THEN event_type ELSE 'click' END"),
    ("tolerance", "0.5"),
    ("keywords", "split(event_type || ',USER,event,absent', ',')"),
    ("expected_tool", "event_type"),
    ("required_key", "'k'"),
    ("response", "CASE WHEN event_id % 9 IN (0, 1) THEN CASE WHEN event_id % 7 = 0 THEN 'no idea' "
                 "ELSE 'value is ' || CAST(value AS STRING) || ' units' END "
                 "WHEN event_id % 9 IN (4, 5) THEN 'An ' || upper(event_type) || CASE WHEN event_id % 3 = 0 THEN ' thing' "
                 "ELSE ' Event by user ' || CAST(user_id AS STRING) END "
                 "WHEN event_id % 9 IN (6, 7) THEN CASE event_id % 5 "
                 "WHEN 0 THEN '{\"tool\":\"' || event_type || '\",\"arguments\":' || props || '}' "
                 "WHEN 1 THEN '{\"tool\":\"other\",\"arguments\":' || props || '}' "
                 "WHEN 2 THEN '{\"tool\":\"' || event_type || '\",\"arguments\":{}}' "
                 "WHEN 3 THEN props || ' trailing' "
                 "ELSE '[1, 2]' END "
                 "ELSE '  ' || upper(event_type) || ' ' END"),
    ("latency_sec", "value / 100"),
]

# The raw task object each attempt row stands for (what a JSONL task line holds).
TASK_VARIANT_SQL = (
    "to_variant_object(named_struct('id', task_id, 'description', prompt, 'expected_output', expected_output, "
    "'tolerance', tolerance, 'expected_keywords', keywords, 'expected_tool', expected_tool, "
    "'required_argument_keys', array(required_key), 'metadata', named_struct('category', category)))"
)


def select_sql(cols: list[tuple[str, str]], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in cols) + f" FROM {source}"


def attempt_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 rows plus ``task`` (VARIANT): the raw task object of each attempt."""
    ev = costly_events(spark, sf_dir)
    df = ev.selectExpr(*[f"{e} AS {n}" for n, e in ATTEMPT_INPUT])
    return df.withColumn("task", F.expr(TASK_VARIANT_SQL))


def attempt_input_sql() -> str:
    return select_sql(ATTEMPT_INPUT, "events")


def attempt_input_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with ``repeat_index``: 0-based order of ``event_id`` within
    (run, model, task file, task). """
    df = attempt_input(spark, sf_dir)
    keys = ["run_id", "model_config_id", "task_file", "task_id"]
    return row_number_within(df, keys, ["event_id"], out="__rn").withColumn(
        "repeat_index", (F.col("__rn") - 1).cast("int")
    ).drop("__rn")


REPEAT_INDEX_SQL = (
    "CAST(row_number() OVER (PARTITION BY run_id, model_config_id, task_file, task_id ORDER BY event_id) - 1 AS INTEGER)"
)


# --- v_task_lines: task files as text lines, with bad lines ----------------

TASK_LINES = [
    ("event_id", "event_id"),
    ("task_file", "'tasks/' || event_type || '.jsonl'"),
    ("line", "CASE event_id % 10 "
             "WHEN 0 THEN '   ' "
             "WHEN 1 THEN '{\"id\": \"t' || CAST(event_id AS STRING) || '\",}' "
             "WHEN 2 THEN '[1, 2]' "
             "WHEN 3 THEN '{\"id\": \"t' || CAST(event_id AS STRING) || '\"}' "
             "WHEN 4 THEN '{\"id\": [1], \"description\": \"d\", \"expected_output\": \"x\"}' "
             "WHEN 5 THEN '{\"id\": 7, \"description\": 3, \"expected_output\": \"x\"}' "
             "WHEN 6 THEN '{\"id\": \"a\", \"description\": \"d\", \"expected_output\": \"\"}' "
             "ELSE '{\"id\": ' || CAST(event_id AS STRING) || ', \"description\": \"d\", \"expected_output\": \"ok ' "
             "|| event_type || CASE WHEN user_id % 4 = 0 THEN 's' ELSE '' END "
             "|| '\", \"metadata\": {\"category\": \"text\"}}' END"),
]


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 rows with ``line_no``: 1-based position of the event within its task file."""
    ev = costly_events(spark, sf_dir)
    df = ev.selectExpr(*[f"{e} AS {n}" for n, e in TASK_LINES])
    # few files hold all lines: numbered block by block of event ids
    numbered = row_number_within(df, ["task_file"], ["event_id"], out="line_no", bucket=F.expr("event_id div 10000"))
    return numbered.select("task_file", "line_no", "line")


def task_lines_sql() -> str:
    inner = select_sql(TASK_LINES, "events")
    return f"SELECT task_file, row_number() OVER (PARTITION BY task_file ORDER BY event_id) AS line_no, line FROM ({inner})"


# --- v_json_texts: tool calls, whole and broken in many ways -------------------

_CALL = (
    "('{\"tool\": \"' || event_type || '\", \"arguments\": ' || props || ',' || chr(10) || ' \"n\": [1, 2.5e3, -7, true, null], \"s\": \"é' "
    "|| CAST(user_id AS STRING) || '\"}')"
)
JSON_TEXTS = [
    ("event_id", "event_id"),
    ("text", "CASE event_id % 17 "
             f"WHEN 0 THEN substr({_CALL}, 1, CAST(event_id % 89 AS INTEGER)) "
             f"WHEN 1 THEN {_CALL} || ' trailing' "
             f"WHEN 2 THEN replace({_CALL}, ', ', ',, ') "
             f"WHEN 3 THEN replace({_CALL}, '\"tool\"', 'tool') "
             f"WHEN 4 THEN replace({_CALL}, ']', ' , ]') "
             f"WHEN 5 THEN replace({_CALL}, '}}', ',}}') "
             f"WHEN 6 THEN replace({_CALL}, ': ', ' ') "
             f"WHEN 7 THEN replace({_CALL}, 'true', 'True') "
             f"WHEN 8 THEN replace({_CALL}, 'null', 'NaN, -Infinity') "
             f"WHEN 9 THEN replace({_CALL}, '2.5e3', '2.') "
             f"WHEN 10 THEN substr({_CALL}, 2) "
             f"WHEN 11 THEN replace({_CALL}, 'é', chr(92) || 'x') "
             f"WHEN 12 THEN replace({_CALL}, 'é', chr(92) || 'u12g4') "
             f"WHEN 13 THEN replace({_CALL}, 'é', chr(9)) "
             "WHEN 14 THEN CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN ' -Infinity ' WHEN 2 THEN '\"NaN\"' WHEN 3 THEN 'nan' "
             "WHEN 4 THEN '' ELSE '[1, 2] [3]' END "
             f"ELSE '  ' || {_CALL} || chr(10) END"),
]


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costly_events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in JSON_TEXTS])


# --- v_valued_tasks: task lines whose expected values are objects, lists, NaN and Infinity ---
# ``said`` is how Python prints the expected value, as the texts below spell it.

VALUED_TASKS = [
    ("event_id", "event_id"),
    ("expected_json", "CASE event_id % 5 "
                      "WHEN 0 THEN '{\"zeta\": 1, \"alpha\": [1.50, {\"k\": \"it' || chr(39) || 's\"}, 1e2], \"kind\": \"' || event_type || '\"}' "
                      "WHEN 1 THEN '[true, null,' || chr(9) || CAST(user_id AS STRING) || ', {\"b\": -0, \"a\": {}}]' "
                      "WHEN 2 THEN 'NaN' WHEN 3 THEN '[-Infinity, {\"y\": NaN, \"x\": \"NaN\"}]' "
                      "ELSE '{\"' || event_type || '\": [], \"a b\": \"tab' || chr(92) || 't\"}' END"),
    ("said", "CASE event_id % 5 "
             "WHEN 0 THEN '{' || chr(39) || 'zeta' || chr(39) || ': 1, ' || chr(39) || 'alpha' || chr(39) || ': [1.5, {' || chr(39) || 'k' || chr(39) "
             "|| ': \"it' || chr(39) || 's\"}, 100.0], ' || chr(39) || 'kind' || chr(39) || ': ' || chr(39) || event_type || chr(39) || '}' "
             "WHEN 1 THEN '[True, None, ' || CAST(user_id AS STRING) || ', {' || chr(39) || 'b' || chr(39) || ': 0, ' || chr(39) || 'a' || chr(39) || ': {}}]' "
             "WHEN 2 THEN 'nan' WHEN 3 THEN '[-inf, {' || chr(39) || 'y' || chr(39) || ': nan, ' || chr(39) || 'x' || chr(39) || ': ' || chr(39) || 'NaN' || chr(39) || '}]' "
             "ELSE '{' || chr(39) || event_type || chr(39) || ': [], ' || chr(39) || 'a b' || chr(39) || ': ' || chr(39) || 'tab' || chr(92) || 't' || chr(39) || '}' END"),
    ("half", "event_id % 2"),
]
# the task line: metadata before the expected value, a nested member of the same name that does not count
VALUED_LINE = (
    "'{\"metadata\": {\"category\": \"text\", \"expected\": 3}, \"id\": ' || CAST(event_id AS STRING) || ', \"description\": \"d\", '"
    " || '\"expected\": ' || expected_json || ', \"expected_output\": \"unused\"}'"
)
VALUED_RESPONSE = "CASE half WHEN 0 THEN ' ' || upper(said) || chr(10) ELSE 'other' END"


def valued_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task lines (task_file, line_no = event_id, line) and a response to each."""
    ev = costly_events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in VALUED_TASKS])
    return ev.selectExpr("'valued.jsonl' AS task_file", "event_id AS line_no", f"{VALUED_LINE} AS line", f"{VALUED_RESPONSE} AS response")


# --- v_call_log: logged model calls ------------------------------------------

CALL_LOG = [
    ("event_id", "event_id"),
    ("transport_error", "CASE WHEN event_id % 11 = 0 THEN 'connection' WHEN event_id % 11 = 1 THEN 'timeout' END"),
    ("status_code", "CAST(CASE WHEN event_id % 11 IN (0, 1) THEN NULL WHEN event_id % 11 = 2 THEN 500 ELSE 200 END AS INTEGER)"),
    ("body", "CASE WHEN event_id % 11 IN (0, 1) THEN NULL "
             "WHEN event_id % 11 = 2 THEN 'server error' "
             "WHEN event_id % 11 = 3 THEN '<html>' "
             "WHEN event_id % 11 = 4 THEN '{\"choices\": []}' "
             "WHEN event_id % 11 = 5 THEN '{\"choices\": [{\"message\": {\"content\": \"ok ' || event_type || '\"}}]}' "
             "ELSE '{\"choices\": [{\"message\": {\"content\": \"ok ' || event_type "
             "|| '\"}}], \"usage\": {\"total_tokens\": ' || CAST(user_id AS STRING) || '}}' END"),
    ("latency_sec", "value / 100"),
]


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = costly_events(spark, sf_dir)
    return ev.selectExpr(*[f"{e} AS {n}" for n, e in CALL_LOG])


def call_log_sql() -> str:
    return select_sql(CALL_LOG, "events")


# --- v_chat_pairs: user turn followed by the assistant's reply ------------------


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join on (conv_id, turn + 1): each user turn meets only its own reply."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return u.join(a, ["conv_id", "turn"])


CHAT_PAIRS_SQL = (
    "SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response FROM conversations u "
    "JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'"
)


# --- v_doc_keywords: long responses for keyword scoring --------------------------


def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("response"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


DOC_KEYWORDS_SQL = (
    "SELECT d.doc_id, d.lang, d.source, d.text AS response, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)


# --- v_work_items: documented work-item rules ------------------------------------

WORK_ITEMS = [
    ("id", "'o-' || CAST(o_orderkey AS STRING)"),
    ("priority", "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"),
    ("status", "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'paused' END"),
    ("due_date", "CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z'"),
    ("depends_on", "'o-' || CAST(o_orderkey + (o_custkey % 3) AS STRING)"),
    ("o_orderkey", "o_orderkey"),
    ("o_custkey", "o_custkey"),
    ("o_totalprice", "o_totalprice"),
    ("o_orderdate", "o_orderdate"),
]


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(*[f"{e} AS {n}" for n, e in WORK_ITEMS])


def work_items_sql() -> str:
    return select_sql(WORK_ITEMS, "orders")


# --- model configs: YAML documents derived from the events table ------------------
# One valid config per model id (user_id % 5), plus one config per event type
# that exercises the loader's checks: 'click' valid, 'view' lacks runtime and
# settings, 'signup' lacks settings.max_tokens, 'error' is a YAML list,
# 'purchase' reuses the id model-0 (a duplicate id).

NL = "chr(10)"

MODEL_CONFIG_TEXT = (
    f"'id: model-' || CAST(m AS STRING) || {NL} || 'model_name: Model ' || CAST(m AS STRING) || {NL} "
    f"|| 'model_path: /models/model-' || CAST(m AS STRING) || '.gguf' || {NL} "
    f"|| 'runtime:' || {NL} || '  engine: llama.cpp' || {NL} "
    f"|| '  server_url: http://127.0.0.1:' || CAST(8080 + m AS STRING) || '/v1/chat/completions' || {NL} "
    f"|| 'settings:' || {NL} || '  context_size: ' || CAST(4096 * (m + 1) AS STRING) || {NL} "
    f"|| '  temperature: ' || CAST(CAST(m AS DOUBLE) / 10 AS STRING) || {NL} || '  top_p: 0.9' || {NL} "
    f"|| '  max_tokens: ' || CAST(256 * (m + 1) AS STRING) || {NL} "
    f"|| 'hardware:' || {NL} || '  gpu: gpu-' || CAST(m AS STRING) || {NL} || '  vram_gb: 16' || {NL} || '  backend: cpu' || {NL}"
)

VARIANT_CONFIG_TEXT = (
    "CASE e "
    f"WHEN 'error' THEN '- a' || {NL} || '- b' || {NL} "
    f"WHEN 'view' THEN 'id: cfg-view' || {NL} || 'model_name: View' || {NL} "
    f"ELSE 'id: ' || CASE e WHEN 'purchase' THEN 'model-0' ELSE 'cfg-' || e END || {NL} || 'model_name: ' || upper(e) || {NL} "
    f"|| 'runtime:' || {NL} || '  server_url: http://127.0.0.1:9000/' || e || {NL} "
    f"|| 'settings:' || {NL} || '  temperature: 0.5' || {NL} || '  top_p: 1.0' || {NL} "
    f"|| CASE WHEN e = 'signup' THEN '' ELSE '  max_tokens: 128' || {NL} END END"
)


def config_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_file, text): five model configs and five loader-check configs."""
    ev = table(spark, sf_dir, "events")
    models = ev.selectExpr("user_id % 5 AS m").distinct().selectExpr(
        "'configs/model-' || CAST(m AS STRING) || '.yaml' AS config_file", f"{MODEL_CONFIG_TEXT} AS text"
    )
    variants = ev.selectExpr("event_type AS e").distinct().selectExpr(
        "'configs/' || e || '.yaml' AS config_file", f"{VARIANT_CONFIG_TEXT} AS text"
    )
    return models.unionByName(variants)


def model_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five valid model configs (model-0 .. model-4) parsed by the loader."""
    from evalgrid.sources.configs import load_configs

    configs, _ = load_configs(config_texts(spark, sf_dir))
    return configs.filter(F.col("config_file").startswith("configs/model-"))


# Oracle form of the model configs' settings (what the YAML above encodes).
MODEL_SETTINGS_SQL = (
    "SELECT DISTINCT 'model-' || CAST(user_id % 5 AS VARCHAR) AS model_config_id, "
    "CAST(4096 * (user_id % 5 + 1) AS INTEGER) AS context_size, CAST(user_id % 5 AS DOUBLE) / 10 AS temperature, "
    "CAST(0.9 AS DOUBLE) AS top_p, CAST(256 * (user_id % 5 + 1) AS INTEGER) AS max_tokens, "
    "'http://127.0.0.1:' || CAST(8080 + user_id % 5 AS VARCHAR) || '/v1/chat/completions' AS server_url FROM events"
)


# --- v_plan / v_completed: resume planning over the benchmark table --------------


def bench_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item planned three times (repeat_index 0..2)."""
    from evalgrid.operators.plan import expand_repeats

    b = table(spark, sf_dir, "benchmark").select(
        "item_id", F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("task_id"), F.length("text").alias("chars")
    )
    return expand_repeats(b, 3).drop("repeat_count")


def bench_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts already done when the run stopped: the first two repeats of
    every item, the third only for items longer than 200 characters."""
    return bench_plan(spark, sf_dir).filter((F.col("repeat_index") < 2) | (F.col("chars") > 200))


BENCH_PLAN_SQL = (
    "SELECT item_id, 'bench-' || CAST(item_id AS VARCHAR) AS task_id, CAST(length(text) AS INTEGER) AS chars, "
    "CAST(unnest(range(0, 3)) AS INTEGER) AS repeat_index FROM benchmark"
)
BENCH_COMPLETED_SQL = f"SELECT * FROM ({BENCH_PLAN_SQL}) WHERE repeat_index < 2 OR chars > 200"


# --- suites: one per event type, plus an archive suite whose file has no tasks ---

SUITES_SQL = (
    "SELECT DISTINCT 'suite-' || event_type AS suite_id, upper(event_type) || ' suite' AS name, "
    "'tasks/' || event_type || '.jsonl' AS task_file FROM events "
    "UNION ALL SELECT DISTINCT 'suite-' || event_type || '-archive', upper(event_type) || ' archive', "
    "'tasks/' || event_type || '_archive.jsonl' FROM events"
)


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type").distinct()
    cur = ev.selectExpr("'suite-' || event_type AS suite_id", "upper(event_type) || ' suite' AS name",
                        "'tasks/' || event_type || '.jsonl' AS task_file")
    arc = ev.selectExpr("'suite-' || event_type || '-archive' AS suite_id", "upper(event_type) || ' archive' AS name",
                        "'tasks/' || event_type || '_archive.jsonl' AS task_file")
    return cur.unionByName(arc)


# --- run status events: an append-only manifest log derived from the events ------

STATUS_EVENTS = [
    ("run_id", "CAST(CAST(ts AS DATE) AS STRING) || '_run'"),
    ("model_config_id", "'model-' || CAST(user_id % 5 AS STRING)"),
    ("task_file", "'tasks/' || event_type || '.jsonl'"),
    ("status", "CASE WHEN value < 20 THEN 'running' WHEN value < 200 THEN 'completed' WHEN value < 400 THEN 'cancelled' ELSE 'failed' END"),
    ("ts", "ts"),
    ("event_id", "event_id"),
]


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in STATUS_EVENTS])


def status_events_sql() -> str:
    return select_sql(STATUS_EVENTS, "events")


# The same log as whole manifests have it: fields come and go, some events carry none, some no status or one that is not allowed.
MANIFEST_EVENTS = [
    *[(n, e) for n, e in STATUS_EVENTS if n != "status"],
    ("status", "CASE WHEN event_id % 6 = 1 THEN CAST(NULL AS STRING) WHEN event_id % 10 = 2 THEN 'paused' "
               "WHEN value < 20 THEN 'running' WHEN value < 200 THEN 'completed' WHEN value < 400 THEN 'cancelled' ELSE 'failed' END"),
    ("model_name", "CASE WHEN event_id % 4 = 0 THEN 'Model ' || CAST(user_id % 5 AS STRING) END"),
    ("suite_id", "CASE WHEN event_id % 5 < 2 THEN 'suite-' || event_type END"),
    ("suite_name", "CASE WHEN event_id % 5 = 1 THEN upper(event_type) || ' suite' END"),
    ("server_url", "CASE WHEN event_id % 3 = 0 THEN 'http://127.0.0.1:' || CAST(8000 + user_id AS STRING) END"),
    ("settings", "CASE WHEN event_id % 7 = 3 THEN '{\"max_tokens\": ' || CAST(user_id AS STRING) || '}' END"),
    ("repeats", "CASE WHEN event_id % 8 = 0 THEN CAST(1 + user_id % 3 AS BIGINT) END"),
    ("total_tasks", "CASE WHEN event_id % 9 = 4 THEN CAST(event_id AS BIGINT) END"),
    ("total_attempts", "CASE WHEN event_id % 9 = 5 THEN CAST(2 * event_id AS BIGINT) END"),
]


def manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in MANIFEST_EVENTS])


# Saved manifests, one run an event, many of them damaged: torn, empty, no object, fields of a wrong type.
_MANIFEST = (
    "'{\"run_id\": \"x\", \"task_file\": \"tasks/' || event_type || '.jsonl\", \"settings\": ' "
    "|| CASE event_id % 3 WHEN 0 THEN '{\"top_p\":1}' WHEN 1 THEN 'null' ELSE '[]' END || ', \"repeats\": ' "
    "|| CASE event_id % 4 WHEN 0 THEN '\"2\"' ELSE CAST(user_id AS STRING) END || ', \"status\": \"' "
    "|| CASE event_id % 5 WHEN 0 THEN 'stopped' WHEN 1 THEN 'failed' ELSE 'completed' END || '\"}'"
)
MANIFEST_DOCUMENTS = [
    ("event_id", "event_id"),
    ("path", "'results/runs/model-' || CAST(user_id % 5 AS STRING) || '/' || CAST(event_id AS STRING) || '_run/manifest.json'"),
    ("text", f"CASE event_id % 11 WHEN 0 THEN substr({_MANIFEST}, 1, 30) WHEN 1 THEN '' WHEN 2 THEN '[' || {_MANIFEST} || ']' "
             f"WHEN 3 THEN CAST(NULL AS STRING) ELSE {_MANIFEST} END"),
    ("user_id", "user_id"),
    ("event_type", "event_type"),
]


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in MANIFEST_DOCUMENTS])
    return docs.select("path", "text")


# --- suites with a scoring of their own, and the rules of each scoring --------------

SCORED_SUITES_SQL = (
    "SELECT DISTINCT 'suite-' || event_type AS suite_id, 'tasks/' || event_type || '.jsonl' AS task_file, "
    "CASE WHEN event_type = 'click' THEN 'deterministic' WHEN event_type = 'view' THEN 'strict' WHEN event_type = 'purchase' THEN 'lenient' END AS scoring "
    "FROM events WHERE event_type <> 'error' UNION ALL SELECT DISTINCT 'suite-click-strict', 'tasks/click.jsonl', 'strict' FROM events WHERE event_type = 'click'"
)
SCORING_RULES_SQL = (
    "SELECT * FROM (VALUES ('strict', 'math', 'exact_match'), ('strict', 'keyword', 'exact_match'), ('strict', 'json', 'exact_match'), "
    "('lenient', 'code', 'json_valid'), ('lenient', NULL, 'keyword_match')) AS t(scoring, category, scorer)"
)


def scored_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type").distinct()
    return spark.sql(SCORED_SUITES_SQL.replace("FROM events", "FROM {ev}"), ev=ev)


def scoring_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(SCORING_RULES_SQL)


# Lines of result files, some of them cut off in the middle.
RAW_LINES = [
    *[(n, e) for n, e in STATUS_EVENTS if n in ("run_id", "model_config_id", "task_file", "event_id")],
    ("line", "substr('{\"task_id\": \"t' || CAST(event_id AS STRING) || '\", \"response\": \"é ' || event_type || '\"}', 1, "
             "CASE WHEN event_id % 7 < 2 THEN 20 ELSE 1000 END)"),
    ("whole", "event_id % 7 >= 2"),
]


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in RAW_LINES])


# --- importer sources derived from the benchmark table ---------------------------

GSM8K_SRC = [
    ("src_id", "item_id"),
    ("question", "text"),
    ("answer", "'Worked steps for item ' || CAST(item_id AS STRING) || ' #### ' || CAST(length(text) AS STRING)"),
]
MC_SRC = [
    ("src_id", "item_id"),
    ("question", "'Which clause comes first in item ' || CAST(item_id AS STRING) || '?'"),
    ("choices", "split(text, ', ')"),
    ("answer_index", "0"),
]
CODE_SRC = [
    ("src_id", "item_id"),
    ("prompt", "'def solve_' || CAST(item_id AS STRING) || '():' || chr(10) || '    # ' || text"),
    ("entry_point", "'solve_' || CAST(item_id AS STRING)"),
]


def bench_source(spark: SparkSession, sf_dir: str, cols: list[tuple[str, str]]) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(*[f"{e} AS {n}" for n, e in cols])


# --- work items, extended with type and hours for the documented rules ---------

WORK_ITEMS_EXTRA = [
    ("type", "CASE o_custkey % 9 WHEN 0 THEN 'code_review' WHEN 1 THEN 'bug_fix' WHEN 2 THEN 'feature' "
             "WHEN 3 THEN 'documentation' WHEN 4 THEN 'refactoring' WHEN 5 THEN 'testing' WHEN 6 THEN 'research' "
             "WHEN 7 THEN 'other' ELSE 'Other' END"),
    ("estimated_hours", "o_totalprice / 1000"),
    ("description", "'Order ' || CAST(o_orderkey AS STRING) || ' for customer ' || CAST(o_custkey AS STRING)"),
    ("assignee", "'cust-' || CAST(o_custkey AS STRING)"),
]


def work_items_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(*[f"{e} AS {n}" for n, e in WORK_ITEMS + WORK_ITEMS_EXTRA])


def work_items_full_sql() -> str:
    return select_sql(WORK_ITEMS + WORK_ITEMS_EXTRA, "orders")


# Legacy-format work items: some fields absent (NULL fields vanish in to_json).
LEGACY_JSON_SQL = (
    "to_json(named_struct('id', id, "
    "'category', CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE type END, "
    "'urgency', CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE priority END, "
    "'state', CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE status END, "
    "'notes', description, "
    "'owner', CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE assignee END, "
    "'deadline', due_date))"
)
