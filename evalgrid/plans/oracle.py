"""Independent DuckDB SQL for the registered queries.

These statements restate each operator's rules in plain SQL over the
fixture columns, for the side-by-side check against the Spark queries. They
share nothing with the Spark implementation except the fixture views, so an
error in one shows up as a mismatch. DuckDB specifics used: RE2 regexes,
``lambda x: ...`` list lambdas, ``json_valid`` (strict), ``json_type``.
"""

from __future__ import annotations

from evalgrid.plans import fixtures as fx

# RE2 form of Python's whitespace class (RE2's \s lacks \v).
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def strict_valid(x: str) -> str:
    """Python-strict JSON validity: DuckDB's parser also accepts trailing commas
    (``{"a": 1,}``), which Python rejects; the fixtures never put ``,}`` or
    ``,]`` inside string values, so a pattern test closes the gap here."""
    return f"(coalesce(json_valid({x}), false) AND NOT regexp_matches({x}, ',\\s*[}}\\]]'))"


_JSON_INSIDE = r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*'
_JSON_TOKEN = (
    rf'[ \t\n\r]+|"{_JSON_INSIDE}"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity|[\[\]{{}}:,]|"|(?s:.+)'
)


def json_error(x: str) -> str:
    """STRUCT(msg, pos): what Python's JSON decoder finds wrong with ``x``; NULL fields for a valid text.

    A walk over tokens of the classes v (scalar), s (whole string), q (broken
    string), x (anything else) and the marks themselves. ``want`` says what
    may follow, ``open`` the brackets that are.
    """
    kind = (
        "CASE WHEN regexp_matches(t, '^[ \\t\\n\\r]') THEN 'w' WHEN t = '\"' THEN 'q' WHEN t[1] = '\"' THEN 's' "
        "WHEN t IN ('{', '}', '[', ']', ':', ',') THEN t "
        "WHEN t IN ('true', 'false', 'null', 'NaN', 'Infinity', '-Infinity') OR regexp_matches(t, '^-?[0-9]') THEN 'v' ELSE 'x' END"
    )
    classes = f"list_transform(regexp_extract_all(j, {q(_JSON_TOKEN)}), lambda t: {{'k': {kind}, 'n': length(t)}})"

    def go(want: str, opened: str = "a.open", comma: str = "a.comma") -> str:
        return f"{{'want': {want}, 'open': {opened}, 'pos': a.pos + t.n, 'comma': {comma}, 'msg': NULL::VARCHAR, 'n': t.n, 'k': t.k}}"

    def halt(msg: str, pos: str = "a.pos") -> str:
        return f"{{'want': a.want, 'open': a.open, 'pos': {pos}, 'comma': a.comma, 'msg': {q(msg)}, 'n': t.n, 'k': t.k}}"

    shut = "a.open[:-2]"
    begin = (
        f"WHEN t.k IN ('v', 's') THEN {go(q('next'))} WHEN t.k = '{{' THEN {go(q('name or end'), 'a.open || t.k')} "
        f"WHEN t.k = '[' THEN {go(q('item or end'), 'a.open || t.k')} WHEN t.k = 'q' THEN {halt('q')} ELSE {halt('Expecting value')} END"
    )
    named = f"WHEN t.k = 's' THEN {go(q(':'))} WHEN t.k = 'q' THEN {halt('q')} ELSE {halt('Expecting property name enclosed in double quotes')} END"
    step = (
        f"CASE WHEN a.msg IS NOT NULL THEN a WHEN t.k = 'w' THEN {go('a.want')} "
        f"WHEN a.want = 'next' AND a.open = '' THEN {halt('Extra data')} "
        f"WHEN a.want = 'next' AND a.open[-1] || t.k IN ('{{}}', '[]') THEN {go(q('next'), shut)} "
        f"WHEN a.want = 'next' AND t.k = ',' THEN {go('CASE a.open[-1] WHEN ' + q('{') + ' THEN ' + q('name') + ' ELSE ' + q('item') + ' END', comma='a.pos')} "
        f"WHEN a.want = 'next' THEN {halt(f"Expecting ',' delimiter")} "
        f"WHEN a.want = ':' AND t.k = ':' THEN {go(q('value'))} WHEN a.want = ':' THEN {halt(f"Expecting ':' delimiter")} "
        f"WHEN a.want = 'name or end' AND t.k = '}}' OR a.want = 'item or end' AND t.k = ']' THEN {go(q('next'), shut)} "
        f"WHEN a.want = 'name' AND t.k = '}}' THEN {halt('Illegal trailing comma before end of object', 'a.comma')} "
        f"WHEN a.want = 'item' AND t.k = ']' THEN {halt('Illegal trailing comma before end of array', 'a.comma')} "
        f"WHEN a.want IN ('name', 'name or end') THEN CASE {named} ELSE CASE {begin} END"
    )
    start = "{'want': 'value', 'open': '', 'pos': 0::BIGINT, 'comma': 0::BIGINT, 'msg': NULL::VARCHAR, 'n': 0::BIGINT, 'k': ''}"
    at_end = (
        "CASE WHEN a.want IN ('name', 'name or end') THEN 'Expecting property name enclosed in double quotes' WHEN a.want = ':' THEN 'Expecting '':'' delimiter' "
        "WHEN a.want <> 'next' THEN 'Expecting value' WHEN a.open <> '' THEN 'Expecting '','' delimiter' END"
    )
    begun = f"regexp_extract(substr(j, a.pos + 1), {q('^' + chr(34) + _JSON_INSIDE)})"
    text = (
        "CASE WHEN rest = '' AND regexp_matches(regexp_replace(b, '\\\\[\"\\\\/bfnrt]', '-', 'g'), '\\\\u[0-9a-fA-F]{4}$') "
        "THEN {'msg': 'Invalid \\uXXXX escape', 'pos': a.pos + length(b) - 5} "
        "WHEN rest IN ('', chr(92)) THEN {'msg': 'Unterminated string starting at', 'pos': a.pos} "
        "WHEN rest[:2] = chr(92) || 'u' THEN {'msg': 'Invalid \\uXXXX escape', 'pos': a.pos + length(b) + 1} "
        "WHEN rest[1] = chr(92) THEN {'msg': 'Invalid \\escape', 'pos': a.pos + length(b)} "
        "ELSE {'msg': 'Invalid control character at', 'pos': a.pos + length(b)} END"
    )
    broken = f"list_transform([{begun}], lambda b: list_transform([substr(j, a.pos + length(b) + 1)], lambda rest: {text})[1])[1]"
    walked = f"list_reduce(list_prepend({start}, list_transform({classes}, lambda c: {{'want': '', 'open': '', 'pos': 0::BIGINT, 'comma': 0::BIGINT, 'msg': NULL::VARCHAR, 'n': c.n, 'k': c.k}})), lambda a, t: {step})"
    return (
        f"list_transform([{x}], lambda j: list_transform([{walked}], lambda a: CASE WHEN a.msg = 'q' THEN {broken} "
        f"ELSE {{'msg': coalesce(a.msg, {at_end}), 'pos': a.pos}} END)[1])[1]"
    )


def json_error_text(x: str) -> str:
    """The decoder's message with its place, as ``str(exc)`` gives it."""
    head = "j[1:e.pos]"
    return (
        f"list_transform([{x}], lambda j: list_transform([{json_error('j')}], lambda e: e.msg || ': line ' "
        f"|| (length({head}) - length(replace({head}, chr(10), '')) + 1) || ' column ' "
        f"|| (length(string_split({head}, chr(10))[-1]) + 1) || ' (char ' || e.pos || ')')[1])[1]"
    )


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NUM_RE = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"

# Each scorer: (score, passed, reason) SQL over v_attempt_input columns.


def exact_sql() -> tuple[str, str, str]:
    e, r = strip("expected_output"), strip("response")
    ok = f"lower({e}) = lower({r})"
    return (
        f"CASE WHEN {ok} THEN 1.0 ELSE 0.0 END",
        ok,
        f"CASE WHEN {ok} THEN 'Matched expected answer' ELSE 'Expected ''' || {e} || ''' but got ''' || {r} || '''' END",
    )


def numeric_sql() -> tuple[str, str, str]:
    e = f"TRY_CAST({strip('expected_output')} AS DOUBLE)"
    m = f"regexp_extract(response, '{NUM_RE}', 0)"
    a = f"CAST(NULLIF({m}, '') AS DOUBLE)"
    within = f"(abs({a} - {e}) <= tolerance)"
    ok = f"({e} IS NOT NULL AND {m} <> '' AND {within})"
    reason = (
        f"CASE WHEN {e} IS NULL THEN 'Task ''expected_output'' is not numeric: ''' || expected_output || '''' "
        f"WHEN {m} = '' THEN 'No number found in response: ''' || {strip('response')} || '''' "
        f"WHEN {within} THEN 'Value ' || CAST({a} AS VARCHAR) || ' within tolerance ' || CAST(tolerance AS VARCHAR) "
        f"|| ' of expected ' || CAST({e} AS VARCHAR) "
        f"ELSE 'Expected ' || CAST({e} AS VARCHAR) || ' (±' || CAST(tolerance AS VARCHAR) || ') but got ' || CAST({a} AS VARCHAR) END"
    )
    return f"CASE WHEN {ok} THEN 1.0 ELSE 0.0 END", ok, reason


def keyword_sql(kw: str = "keywords", resp: str = "response", threshold: str = "0.7") -> tuple[str, str, str]:
    m = f"len(list_filter({kw}, lambda k: contains(lower({resp}), lower(k))))"
    n = f"len({kw})"
    score = f"(CAST({m} AS DOUBLE) / {n})"
    ok = f"({n} = 0 OR {score} >= {threshold})"
    head = f"'Matched ' || CAST({m} AS VARCHAR) || '/' || CAST({n} AS VARCHAR) || ' keywords (threshold={threshold})'"
    missing = f"array_to_string(list_filter({kw}, lambda k: NOT contains(lower({resp}), lower(k))), ', ')"
    reason = (
        f"CASE WHEN {n} = 0 THEN 'No keywords required' WHEN {ok} THEN {head} "
        f"ELSE {head} || '; missing: ' || {missing} END"
    )
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE {score} END", ok, reason


def _kind(t: str) -> str:
    return (
        f"CASE {t} WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' "
        f"WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END"
    )


def json_sql() -> tuple[str, str, str]:
    raw = strip("response")
    valid = strict_valid(raw)
    s = f"(CASE WHEN {valid} THEN {raw} END)"
    kind = f"json_type({s})"
    ttype = f"json_type({s}, '$.tool')"
    tool_ok = f"({ttype} = 'VARCHAR' AND json_extract_string({s}, '$.tool') = expected_tool)"
    atype = f"json_type({s}, '$.arguments')"
    has_key = f"list_contains(json_keys({s}, '$.arguments'), required_key)"
    req_ok = f"({atype} = 'OBJECT' AND {has_key})"
    tool_reason = (
        f"CASE WHEN {ttype} IS NULL THEN 'Missing ''tool'' key (expected ''' || expected_tool || ''')' "
        f"WHEN NOT {tool_ok} THEN 'Tool mismatch: expected ''' || expected_tool || ''', got ''' || json_extract_string({s}, '$.tool') || '''' "
        f"ELSE 'Tool matches: ''' || expected_tool || '''' END"
    )
    req_reason = (
        f"CASE WHEN {atype} IS NULL OR {atype} = 'NULL' THEN 'Missing ''arguments'' key in response' "
        f"WHEN {atype} <> 'OBJECT' THEN '''arguments'' is not an object: ' || {_kind(atype)} "
        f"WHEN NOT {has_key} THEN 'Missing argument keys: ' || required_key "
        f"ELSE 'All required argument keys present: ' || required_key END"
    )
    ok_n = f"(1 + CAST({tool_ok} AS INTEGER) + CAST(coalesce({req_ok}, false) AS INTEGER))"
    dict_ok = f"({valid} AND {kind} = 'OBJECT')"
    score = f"CASE WHEN {dict_ok} THEN round({ok_n} / 3.0, 4) ELSE 0.0 END"
    passed = f"({dict_ok} AND {ok_n} = 3)"
    reason = (
        f"CASE WHEN NOT {valid} THEN 'Invalid JSON: ' || {json_error_text(raw)} "
        f"WHEN {kind} <> 'OBJECT' THEN 'JSON parsed but result is ' || {_kind(kind)} || ', expected object' "
        f"ELSE 'JSON parsed successfully; ' || {tool_reason} || '; ' || {req_reason} END"
    )
    return score, passed, reason


SCORERS = {
    "exact_match": exact_sql,
    "numeric_close": numeric_sql,
    "keyword_match": keyword_sql,
    "json_valid": json_sql,
}

CATEGORY_CASE = (
    "CASE category WHEN 'math' THEN 'numeric_close' WHEN 'numeric' THEN 'numeric_close' "
    "WHEN 'text' THEN 'exact_match' WHEN 'general' THEN 'exact_match' WHEN 'keyword' THEN 'keyword_match' "
    "WHEN 'code' THEN 'keyword_match' WHEN 'json' THEN 'json_valid' WHEN 'tool' THEN 'json_valid' ELSE 'exact_match' END"
)


def scored_one(name: str) -> str:
    score, passed, reason = SCORERS[name]()
    return (
        f"SELECT event_id, '{name}' AS scorer, CAST({score} AS DOUBLE) AS score, CAST({passed} AS BOOLEAN) AS passed, "
        f"{reason} AS reason FROM ({fx.attempt_input_sql()})"
    )


def scored_all(extra: str = "") -> str:
    """Every attempt scored by its category's scorer (one CASE per field)."""
    parts = {n: f() for n, f in SCORERS.items()}

    def pick(i: int) -> str:
        return "CASE scorer " + " ".join(f"WHEN '{n}' THEN {p[i]}" for n, p in parts.items()) + " END"

    return (
        f"SELECT event_id, run_id, model_config_id, task_file, task_id, category, scorer, prompt, expected_output, response, "
        f"latency_sec{extra}, CAST({pick(0)} AS DOUBLE) AS score, CAST({pick(1)} AS BOOLEAN) AS passed, {pick(2)} AS reason "
        f"FROM (SELECT *, {CATEGORY_CASE} AS scorer FROM ({fx.attempt_input_sql()}))"
    )


def scored_by_suite() -> str:
    """Every attempt scored once for each suite of its task file, by the suite's own rules where it has one."""
    parts = {n: f() for n, f in SCORERS.items()}

    def pick(i: int) -> str:
        return "CASE scorer " + " ".join(f"WHEN '{n}' THEN {p[i]}" for n, p in parts.items()) + " END"

    rules = f"({fx.SCORING_RULES_SQL})"
    return (
        f"SELECT suite_id, event_id, scorer, CAST({pick(0)} AS DOUBLE) AS score, CAST({pick(1)} AS BOOLEAN) AS passed, {pick(2)} AS reason FROM ("
        f"SELECT a.*, s.suite_id, coalesce(named.scorer, other.scorer, {CATEGORY_CASE.replace('category', 'a.category')}) AS scorer "
        f"FROM ({fx.attempt_input_sql()}) a LEFT JOIN ({fx.SCORED_SUITES_SQL}) s ON s.task_file = a.task_file "
        f"LEFT JOIN {rules} named ON named.scoring = s.scoring AND named.category = a.category "
        f"LEFT JOIN {rules} other ON other.scoring = s.scoring AND other.category IS NULL)"
    )


def exact_sum(x: str) -> str:
    """Sum of finite doubles without loss: multiples of 2**-20 as integers, and what is left, below 2**-21, apart."""
    steps = f"round(CAST({x} AS DOUBLE) * 1048576)"
    return f"(CAST(sum(CAST({steps} AS HUGEINT)) AS DOUBLE) / 1048576 + sum(CAST({x} AS DOUBLE) - {steps} / 1048576))"


def run_summary_sql(attempts_sql: str | None = None) -> str:
    a = attempts_sql or scored_all()
    return f"""
WITH a AS ({a}),
t AS (SELECT run_id, model_config_id, task_file, task_id, count(*) AS n,
             count(*) FILTER (WHERE passed) AS p
      FROM a GROUP BY run_id, model_config_id, task_file, task_id),
m AS (SELECT run_id, model_config_id, task_file, {exact_sum('score')} AS s, {exact_sum('latency_sec')} AS l FROM a
      GROUP BY run_id, model_config_id, task_file)
SELECT run_id, model_config_id, task_file,
       CAST(count(*) AS BIGINT) AS total_tasks,
       CAST(sum(n) AS BIGINT) AS total_attempts,
       CAST(sum(p) AS BIGINT) AS passed,
       CAST(sum(n) - sum(p) AS BIGINT) AS failed,
       CASE WHEN sum(n) > 0 THEN CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE 0.0 END AS pass_rate,
       CASE WHEN sum(n) > 0 THEN max(s) / CAST(sum(n) AS DOUBLE) ELSE 0.0 END AS average_score,
       CASE WHEN sum(n) > 0 THEN max(l) / CAST(sum(n) AS DOUBLE) ELSE 0.0 END AS average_latency_sec,
       CAST(max(n) AS INTEGER) AS repeats
FROM t JOIN m USING (run_id, model_config_id, task_file) GROUP BY run_id, model_config_id, task_file"""


def latest_sql(summary_sql: str) -> str:
    return f"""
SELECT model_config_id, task_file, total_tasks, total_attempts, repeats, pass_rate, average_score, average_latency_sec
FROM (SELECT *, row_number() OVER (PARTITION BY model_config_id, task_file ORDER BY run_id DESC) AS rn FROM ({summary_sql}))
WHERE rn = 1"""


def markdown_sql(board_sql: str) -> str:
    title = "# Local Model Benchmark Leaderboard"
    header = "| Model Config | Task File | Total Tasks | Total Attempts | Repeats | Pass Rate | Avg Score | Avg Latency |"
    align = "|---|---:|---:|---:|---:|---:|---:|---:|"
    return f"""
SELECT CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT 1 AS line_no, {q(title)} AS line UNION ALL SELECT 2, '' UNION ALL SELECT 3, {q(header)} UNION ALL SELECT 4, {q(align)}
  UNION ALL
  SELECT 4 + row_number() OVER (ORDER BY average_score DESC, pass_rate DESC, average_latency_sec ASC, model_config_id, task_file),
         '| ' || model_config_id || ' | ' || task_file || ' | ' || CAST(total_tasks AS VARCHAR) || ' | '
         || CAST(total_attempts AS VARCHAR) || ' | ' || CAST(repeats AS VARCHAR) || ' | '
         || printf('%.1f', pass_rate * 100) || '% | ' || printf('%.2f', average_score) || ' | '
         || printf('%.2f', average_latency_sec) || 's |'
  FROM ({board_sql}))"""


# ---------------------------------------------------------------------------
# Task-file parsing and validation over v_task_lines
# ---------------------------------------------------------------------------


def _jkind(t: str) -> str:
    return (
        f"CASE {t} WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' "
        f"WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' "
        f"WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' END"
    )


def checked_lines_sql() -> str:
    """Every non-blank fixture line with its parse result and first error."""
    s = strip("line")
    return f"""
WITH l AS ({fx.task_lines_sql()}),
p AS (SELECT task_file, line_no, line, CASE WHEN {strict_valid(s)} THEN {s} END AS j
      FROM l WHERE {s} <> ''),
k AS (SELECT *, {_jkind('json_type(j)')} AS kind,
             CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS keys,
             {_jkind("json_type(j, '$.id')")} AS id_k, {_jkind("json_type(j, '$.description')")} AS d_k,
             {_jkind("json_type(j, '$.expected_output')")} AS e_k
      FROM p),
m AS (SELECT *, list_filter(['description', 'expected_output', 'id'], lambda f: NOT list_contains(keys, f)) AS missing FROM k)
SELECT task_file, line_no, line, j, id_k,
  CASE WHEN j IS NULL THEN 'parsing' WHEN kind <> 'dict' THEN 'not_object'
       WHEN len(missing) > 0 OR id_k NOT IN ('str', 'int', 'bool') OR d_k <> 'str' OR e_k <> 'str'
         OR (id_k = 'str' AND json_extract_string(j, '$.id') = '') OR json_extract_string(j, '$.description') = ''
         OR json_extract_string(j, '$.expected_output') = '' THEN 'validation' END AS error_type,
  CASE WHEN j IS NULL OR kind <> 'dict' THEN NULL WHEN len(missing) > 0 THEN 'required_fields'
       WHEN id_k NOT IN ('str', 'int', 'bool') THEN 'id' WHEN d_k <> 'str' THEN 'description' WHEN e_k <> 'str' THEN 'expected_output'
       WHEN id_k = 'str' AND json_extract_string(j, '$.id') = '' THEN 'id'
       WHEN json_extract_string(j, '$.description') = '' THEN 'description'
       WHEN json_extract_string(j, '$.expected_output') = '' THEN 'expected_output' END AS field,
  CASE WHEN j IS NULL THEN 'Invalid JSON on line ' || CAST(line_no AS VARCHAR) || ': ' || ({json_error(s)}).msg
       WHEN kind <> 'dict' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': Expected JSON object, got ' || kind
       WHEN len(missing) > 0 THEN 'Line ' || CAST(line_no AS VARCHAR) || ': Missing required fields: ' || array_to_string(missing, ', ')
       WHEN id_k NOT IN ('str', 'int', 'bool') THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''id'' must be a string or integer'
       WHEN d_k <> 'str' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''description'' must be a string'
       WHEN e_k <> 'str' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''expected_output'' must be a string'
       WHEN id_k = 'str' AND json_extract_string(j, '$.id') = '' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''id'' cannot be empty'
       WHEN json_extract_string(j, '$.description') = '' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''description'' cannot be empty'
       WHEN json_extract_string(j, '$.expected_output') = '' THEN 'Line ' || CAST(line_no AS VARCHAR) || ': ''expected_output'' cannot be empty'
  END AS message
FROM m"""


def task_errors_sql() -> str:
    return (
        f"SELECT task_file, CAST(line_no AS BIGINT) AS line_no, error_type, field, message, line AS raw_line "
        f"FROM ({checked_lines_sql()}) WHERE error_type IS NOT NULL"
    )


def json_beginning(x: str) -> str:
    """Brute force: the longest of all beginnings of ``x`` that some closing brackets (three at most) make valid."""
    closers = "['', '}', ']', '}}', ']}', '}]', ']]', '}}}', ']}}', '}]}', ']]}', '}}]', ']}]', '}]]', ']]]']"
    ends = "(j[i:i] NOT IN (' ', ',', ':', chr(9), chr(10), chr(13)))"
    # DuckDB also reads nan and inf in other cases, which are no JSON
    bare = "regexp_replace(j[1:i], '\"([^\"\\\\]|\\\\.)*\"', '', 'g')"
    lax = f"regexp_matches(replace(replace({bare}, 'NaN', ''), 'Infinity', ''), '(?i)nan|inf')"
    closed = f"list_filter({closers}, lambda c: {strict_valid('(j[1:i] || c)')} AND NOT {lax})"
    tried = f"list_transform(list_filter(range(length(j), 0, -1), lambda i: {ends}), lambda i: j[1:i] || {closed}[1])"
    return f"list_transform([{x}], lambda j: list_filter({tried}, lambda b: b IS NOT NULL)[1])[1]"


def error_records_sql() -> str:
    s = strip("line")
    saved = f"CASE error_type WHEN 'parsing' THEN {json_beginning(s)} WHEN 'validation' THEN {s} END"
    return f"""SELECT task_file, CAST(line_no AS BIGINT) AS line, error_type, message,
        CASE WHEN error_type = 'parsing' THEN CAST(({json_error(s)}).pos AS INTEGER) END AS char,
        CASE WHEN error_type = 'not_object' THEN regexp_extract(message, 'got (.*)$', 1) END AS kind, field,
        CASE WHEN field = 'required_fields' THEN regexp_extract(message, 'fields: (.*)$', 1) END AS missing,
        CASE WHEN starts_with({saved}, '{{') THEN {saved} END AS task_partial
        FROM ({checked_lines_sql()}) WHERE error_type IS NOT NULL"""


def scan_tasks_sql() -> str:
    cat = "coalesce(json_extract_string(j, '$.metadata.category'), '')"
    return (
        f"SELECT task_file, CAST(line_no AS BIGINT) AS line_no, json_extract_string(j, '$.id') AS id, "
        f"json_extract_string(j, '$.description') AS description, json_extract_string(j, '$.expected_output') AS expected_output, "
        f"{cat} AS category, {CATEGORY_CASE.replace('CASE category', 'CASE ' + cat)} AS scorer "
        f"FROM ({checked_lines_sql()}) WHERE error_type IS NULL"
    )
