"""JSON texts read token by token in SQL: where and why a text is no JSON, and its parts in document order.

``TOKEN`` cuts a text into tokens, each character in exactly one. What can
never stand in JSON is one token up to the text's end, so a long text that is
no JSON has few. ``json_error_sql`` folds the tokens through a pushdown
automaton (a state and a stack of open brackets) that stops where Python's
decoder does, and says the same. It is meant for texts that a parse has
rejected; everything runs in the JVM.

``json_beginning_sql`` walks the same way and keeps what can be saved of a
broken text.

``member_text_sql`` finds a member of an object in its text, so that nested
values can be printed with their keys in the text's order (VARIANT sorts them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalgrid.functions.text import _e, lit, raw

# A string's characters and escapes; possessive, so that no text is too long for the regex engine.
_INSIDE = r'(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+'
_STRING = f'"{_INSIDE}"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_WORD = "true|false|null|NaN|-?Infinity"
#: White space, a whole string, a number, a word, a mark, the quote of a broken string, or the rest of the text.
TOKEN = rf'[ \t\n\r]++|{_STRING}|{_NUMBER}|{_WORD}|[\[\]{{}}:,]|"|(?s:.++)'

# How a value may begin.
_BEGINS = r'^[ \t\n\r]*+[\[{"0-9tfnNI-]'

# The decoder's messages.
EXPECTING_VALUE = "Expecting value"
EXPECTING_NAME = "Expecting property name enclosed in double quotes"
EXPECTING_COLON = "Expecting ':' delimiter"
EXPECTING_COMMA = "Expecting ',' delimiter"
TRAILING_IN_OBJECT = "Illegal trailing comma before end of object"
TRAILING_IN_ARRAY = "Illegal trailing comma before end of array"
EXTRA_DATA = "Extra data"
UNTERMINATED = "Unterminated string starting at"
CONTROL_CHARACTER = "Invalid control character at"
BAD_ESCAPE = "Invalid \\escape"
BAD_UNICODE = "Invalid \\uXXXX escape"
BOM = "Unexpected UTF-8 BOM (decode using utf-8-sig)"

# What may come next.
_VALUE, _FIRST_ITEM, _NEXT_ITEM, _FIRST_NAME, _NEXT_NAME, _COLON, _AFTER = range(7)
_BROKEN_STRING = "string"  # stands for the message until the string is looked into


def let(value: str, name: str, body: str) -> str:
    """SQL ``body`` in which ``name`` is ``value``, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {raw(TOKEN)}, 0)"


def _step() -> str:
    """The automaton's step from ``a`` (state, stack, at, comma, message, place) over token ``t``."""

    def to(state: str, stack: str = "a.stack", comma: str = "a.comma") -> str:
        return (
            f"named_struct('state', {state}, 'stack', {stack}, 'at', a.at + length(t), 'comma', {comma}, "
            "'message', CAST(NULL AS STRING), 'place', 0)"
        )

    def stop(message: str, place: str = "a.at") -> str:
        return f"named_struct('state', a.state, 'stack', a.stack, 'at', a.at, 'comma', a.comma, 'message', {lit(message)}, 'place', {place})"

    popped = "left(a.stack, length(a.stack) - 1)"
    whole_string = "(startswith(t, '\"') AND length(t) > 1)"
    scalar = f"({whole_string} OR t RLIKE r'^(?:-?[0-9]|-?Infinity$|true$|false$|null$|NaN$)')"
    value = (
        f"WHEN t = '{{' THEN {to(str(_FIRST_NAME), 'concat(a.stack, t)')} WHEN t = '[' THEN {to(str(_FIRST_ITEM), 'concat(a.stack, t)')} "
        f"WHEN {scalar} THEN {to(str(_AFTER))} WHEN t = '\"' THEN {stop(_BROKEN_STRING)} ELSE {stop(EXPECTING_VALUE)} END"
    )
    name = f"WHEN {whole_string} THEN {to(str(_COLON))} WHEN t = '\"' THEN {stop(_BROKEN_STRING)} ELSE {stop(EXPECTING_NAME)} END"
    closes = "(t = '}' AND endswith(a.stack, '{') OR t = ']' AND endswith(a.stack, '['))"
    following = f"CASE WHEN endswith(a.stack, '{{') THEN {_NEXT_NAME} ELSE {_NEXT_ITEM} END"
    after = (
        f"CASE WHEN a.stack = '' THEN {stop(EXTRA_DATA)} WHEN {closes} THEN {to(str(_AFTER), popped)} "
        f"WHEN t = ',' THEN {to(following, comma='a.at')} ELSE {stop(EXPECTING_COMMA)} END"
    )
    return (
        "CASE WHEN a.message IS NOT NULL THEN a "
        f"WHEN t RLIKE r'^[ \\t\\n\\r]' THEN {to('a.state')} "
        f"WHEN a.state = {_AFTER} THEN {after} "
        f"WHEN a.state = {_COLON} THEN CASE WHEN t = ':' THEN {to(str(_VALUE))} ELSE {stop(EXPECTING_COLON)} END "
        f"WHEN a.state = {_FIRST_NAME} THEN CASE WHEN t = '}}' THEN {to(str(_AFTER), popped)} {name} "
        f"WHEN a.state = {_NEXT_NAME} THEN CASE WHEN t = '}}' THEN {stop(TRAILING_IN_OBJECT, 'a.comma')} {name} "
        f"WHEN a.state = {_FIRST_ITEM} THEN CASE WHEN t = ']' THEN {to(str(_AFTER), popped)} {value} "
        f"WHEN a.state = {_NEXT_ITEM} THEN CASE WHEN t = ']' THEN {stop(TRAILING_IN_ARRAY, 'a.comma')} {value} "
        f"ELSE CASE {value} END"
    )


def _at_end() -> str:
    """What is wrong with a text whose tokens ran out: message and place."""
    missing = (
        f"CASE WHEN a.state IN ({_FIRST_NAME}, {_NEXT_NAME}) THEN {lit(EXPECTING_NAME)} WHEN a.state = {_COLON} THEN {lit(EXPECTING_COLON)} "
        f"WHEN a.state <> {_AFTER} THEN {lit(EXPECTING_VALUE)} WHEN a.stack <> '' THEN {lit(EXPECTING_COMMA)} END"
    )
    return f"named_struct('message', coalesce(a.message, {missing}), 'place', CASE WHEN a.message IS NULL THEN a.at ELSE a.place END)"


def _broken_string(text: str, place: str) -> str:
    """Why the string that begins at ``place`` does not end: message and place."""
    begun = f"regexp_extract(substring({text}, {place} + 1), {raw('^' + chr(34) + _INSIDE)}, 0)"

    def found(message: str, where: str) -> str:
        return f"named_struct('message', {lit(message)}, 'place', {where})"

    end = f"{place} + length(b)"
    following = f"substring({text}, {end} + 1, 2)"
    # a text that ends with a unicode escape: the decoder asks for more before it reads the digits
    cut_unicode = f"regexp_replace(b, {raw(r'\\[' + chr(34) + r'\\/bfnrt]')}, '-') RLIKE {raw(r'\\u[0-9a-fA-F]{4}$')}"
    body = (
        f"CASE WHEN n = '' AND {cut_unicode} THEN {found(BAD_UNICODE, f'{end} - 5')} "
        f"WHEN n = '' OR n = '\\\\' THEN {found(UNTERMINATED, place)} "
        f"WHEN startswith(n, '\\\\u') THEN {found(BAD_UNICODE, f'{end} + 1')} "
        f"WHEN startswith(n, '\\\\') THEN {found(BAD_ESCAPE, end)} "
        f"ELSE {found(CONTROL_CHARACTER, end)} END"
    )
    return let(begun, "b", let(following, "n", body))


def json_error_sql(text: str) -> str:
    """STRUCT<message, place>: what Python's decoder says of ``text`` (no JSON), and at which character.

    ``message`` is NULL for a text in which this automaton finds no error.
    """
    start = (
        f"named_struct('state', {_VALUE}, 'stack', '', 'at', 0, 'comma', 0, 'message', CAST(NULL AS STRING), 'place', 0)"
    )
    walked = f"aggregate({tokens_sql('x')}, {start}, (a, t) -> {_step()}, a -> {_at_end()})"
    looked = let(walked, "w", f"CASE WHEN w.message = {lit(_BROKEN_STRING)} THEN {_broken_string('x', 'w.place')} ELSE w END")
    # most rejected texts are prose: wrong where they begin, so no token is cut
    prose = f"named_struct('message', {lit(EXPECTING_VALUE)}, 'place', length(regexp_extract(x, {raw('^[ \\t\\n\\r]*+')}, 0)))"
    bom = f"WHEN startswith(x, '\\ufeff') THEN named_struct('message', {lit(BOM)}, 'place', 0)"
    return let(text, "x", f"CASE {bom} WHEN NOT x RLIKE {raw(_BEGINS)} THEN {prose} ELSE {looked} END")


def json_beginning_sql(text: str) -> str:
    """The longest beginning of ``text`` that is JSON once its open brackets are closed, and closed so.

    The automaton's walk, which also keeps the last place after a whole value
    or an opening bracket, and the brackets open there. Member names without
    a value, commas and broken strings are left off; a number counts as far as
    it is one. NULL if no value begins, and for a NULL or empty text.
    """
    begin = (
        f"named_struct('w', named_struct('state', {_VALUE}, 'stack', '', 'at', 0, 'comma', 0, 'message', CAST(NULL AS STRING), 'place', 0), "
        "'good', 0, 'held', '')"
    )
    here = f"n.message IS NULL AND n.state IN ({_AFTER}, {_FIRST_ITEM}, {_FIRST_NAME}) AND NOT t RLIKE r'^[ \\t\\n\\r]'"
    kept = f"named_struct('w', n, 'good', CASE WHEN {here} THEN n.at ELSE p.good END, 'held', CASE WHEN {here} THEN n.stack ELSE p.held END)"
    walked = f"aggregate({tokens_sql('x')}, {begin}, (p, t) -> {let('p.w', 'a', let(_step(), 'n', kept))})"
    closed = "CASE WHEN w.good > 0 THEN concat(left(x, w.good), reverse(translate(w.held, '{[', '}]'))) END"
    return let(text, "x", f"CASE WHEN x RLIKE {raw(_BEGINS)} THEN {let(walked, 'w', closed)} END")


def json_error_text_sql(text: str) -> str:
    """The decoder's whole message: ``Expecting value: line 1 column 1 (char 0)``."""
    before = "left(y, e.place)"
    line = f"CAST(length({before}) - length(replace({before}, '\\n', '')) + 1 AS STRING)"
    column = f"CAST(length(substring_index({before}, '\\n', -1)) + 1 AS STRING)"
    whole = f"concat(e.message, ': line ', {line}, ' column ', {column}, ' (char ', CAST(e.place AS STRING), ')')"
    return let(text, "y", let(json_error_sql("y"), "e", whole))


def marked_sql(text: str, nan: str, infinity: str) -> str:
    """``text`` with its words NaN and Infinity (not those in strings) as the JSON texts ``nan`` and ``infinity``."""
    changed = f"CASE t WHEN 'NaN' THEN {lit(nan)} WHEN 'Infinity' THEN {lit(infinity)} WHEN '-Infinity' THEN {lit('-' + infinity)} ELSE t END"
    return (
        f"CASE WHEN contains({text}, 'NaN') OR contains({text}, 'Infinity') "
        f"THEN array_join(transform({tokens_sql(text)}, t -> {changed}), '') ELSE {text} END"
    )


def member_text_sql(text: str, name: str) -> str:
    """The text of member ``name`` (the last of that name) of the object in ``text``, without white space; NULL if absent.

    ``text`` is a JSON object, ``name`` SQL for a name; escapes in the text's names are read.
    """
    own = "CASE WHEN startswith(a.prior, '\"') AND contains(a.prior, '\\\\') THEN try_variant_get(try_parse_json(a.prior), '$', 'string') ELSE substring(a.prior, 2, length(a.prior) - 2) END"
    depth = "a.depth + CASE WHEN t IN ('{', '[') THEN 1 WHEN t IN ('}', ']') THEN -1 ELSE 0 END"
    begins = f"(a.depth = 1 AND t = ':' AND {own} = {name})"
    ends = "(a.open AND a.depth = 1 AND t IN (',', '}'))"
    step = (
        f"named_struct('depth', {depth}, 'prior', t, 'n', a.n + 1, 'open', CASE WHEN {begins} THEN true WHEN {ends} THEN false ELSE a.open END, "
        f"'first', CASE WHEN {begins} THEN a.n + 2 ELSE a.first END, 'size', CASE WHEN {begins} THEN 0 WHEN {ends} THEN a.n + 1 - a.first ELSE a.size END)"
    )
    start = "named_struct('depth', 0, 'prior', '', 'n', 0, 'open', false, 'first', 0, 'size', 0)"
    place = f"aggregate(ts, {start}, (a, t) -> {step})"
    found = let(place, "p", "CASE WHEN p.first > 0 THEN array_join(slice(ts, p.first, p.size), '') END")
    return let(f"filter({tokens_sql(text)}, t -> NOT t RLIKE r'^[ \\t\\n\\r]')", "ts", found)


# Column forms -------------------------------------------------------------


def json_error(x: str) -> Column:
    return F.expr(json_error_sql(_e(x)))


def json_beginning(x: str) -> Column:
    return F.expr(json_beginning_sql(_e(x)))


def json_error_text(x: str) -> Column:
    return F.expr(json_error_text_sql(_e(x)))


def member_text(x: str, name: str) -> Column:
    return F.expr(member_text_sql(_e(x), lit(name)))
