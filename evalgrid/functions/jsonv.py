"""VARIANT helpers: strict JSON parsing and Python-like views of JSON values.

A task or response is parsed once into a VARIANT column; these helpers read
from it without re-parsing. Absent vs JSON null stays observable:
``try_variant_get(v, '$.k', 'variant')`` is SQL NULL when the key is absent
and a variant null (``is_variant_null``) when the key holds JSON null.

Like ``text.py`` every helper has a ``*_sql`` text form and a Column form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.jsontext import json_error_text_sql, let, marked_sql, tokens_sql
from evalgrid.functions.text import _e, float_repr_sql, py_float_sql, py_repr_str_sql, strip_sql


def _typed(v: str, t: str) -> str:
    return f"try_variant_get({v}, '$', '{t}')"


#: JSON texts that stand in a VARIANT for Python's NaN (the negative double nearest to zero) and Infinity (out of range).
NAN_TEXT, INFINITY_TEXT = "-4.9E-324", "1e999"


def with_strict_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the SQL text ``text`` parsed like ``json.loads(s.strip())``; VARIANT, or NULL if invalid.

    ``try_parse_json`` ignores what follows the first value. So the text is
    parsed once, as the first of two items of a list; the second is the
    text's own hash: only if the list has these two and ends there is the
    first a whole value. The words NaN and Infinity, which Python takes, are
    numbers that no other text gives (``NAN_TEXT``, ``INFINITY_TEXT``).
    """
    df = df.withColumn("__js", F.expr(strip_sql(text)))
    listed = f"try_parse_json(concat('[', {marked_sql('__js', NAN_TEXT, INFINITY_TEXT)}, ',', CAST(xxhash64(__js) AS STRING), ']'))"
    df = df.withColumn("__jp", F.expr(listed))
    whole = "try_variant_get(__jp, '$[1]', 'bigint') = xxhash64(__js) AND try_variant_get(__jp, '$[2]', 'variant') IS NULL"
    return df.withColumn(out, F.expr(f"CASE WHEN {whole} THEN try_variant_get(__jp, '$[0]', 'variant') END")).drop("__js", "__jp")


def double_sql(v: str) -> str:
    """A VARIANT number as a double, NaN where ``NAN_TEXT`` stands for it."""
    return f"CASE WHEN {_typed(v, 'double')} = DOUBLE('{NAN_TEXT}') THEN DOUBLE('NaN') ELSE {_typed(v, 'double')} END"


def vget_sql(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def is_json_null_sql(v: str) -> str:
    return f"coalesce(is_variant_null({v}), false)"


def json_kind_sql(v: str) -> str:
    """Python ``type(x).__name__`` of a VARIANT; NULL when absent.

    JSON integers are ``int`` (BIGINT, or DECIMAL(p,0) with p > 18: a plain
    ``1.0`` reads as DECIMAL(1,0) and stays a float); other numbers ``float``.
    """
    t = f"schema_of_variant({v})"
    return (
        f"CASE WHEN {v} IS NULL THEN CAST(NULL AS STRING) "
        f"WHEN startswith({t}, 'OBJECT') THEN 'dict' WHEN startswith({t}, 'ARRAY') THEN 'list' "
        f"WHEN {t} = 'STRING' THEN 'str' WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {t} = 'VOID' THEN 'NoneType' "
        f"WHEN {t} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'int' "
        f"WHEN {t} RLIKE r'^DECIMAL\\((19|[2-9][0-9]),0\\)$' THEN 'int' ELSE 'float' END"
    )


def py_text_sql(v: str, k: str | None = None) -> str:
    """Python ``str(x)`` of a VARIANT: strings as is, ints as digits, floats
    with ``repr``, True/False, None; lists/objects as compact JSON (Python
    would print its own repr there; only scalar forms are relied on)."""
    k = k or f"({json_kind_sql(v)})"
    return (
        f"CASE WHEN {k} IN ('str', 'int') THEN {_typed(v, 'string')} "
        f"WHEN {k} = 'float' THEN {let(double_sql(v), 'd', float_repr_sql('d'))} "
        f"WHEN {k} = 'bool' THEN CASE WHEN {_typed(v, 'boolean')} THEN 'True' ELSE 'False' END "
        f"WHEN {k} = 'NoneType' THEN 'None' ELSE to_json({v}) END"
    )


def py_nested_sql(text: str) -> str:
    """Python ``str`` of a list or object given as JSON text without white space, whatever its depth.

    Each token is rewritten on its own, so no recursion is needed. Objects
    print their names in the text's order, each as often as it is there.
    """
    string = py_repr_str_sql("try_variant_get(try_parse_json(t), '$', 'string')")
    number = f"CASE WHEN t RLIKE r'[.eE]' THEN {float_repr_sql('t')} WHEN t = '-0' THEN '0' ELSE t END"
    one = (
        "CASE t WHEN ':' THEN ': ' WHEN ',' THEN ', ' WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' WHEN 'null' THEN 'None' "
        f"WHEN 'NaN' THEN 'nan' WHEN '{NAN_TEXT}' THEN 'nan' WHEN 'Infinity' THEN 'inf' WHEN '-Infinity' THEN '-inf' "
        f"ELSE CASE WHEN startswith(t, '\"') THEN {string} WHEN t RLIKE r'^-?[0-9]' THEN {number} ELSE t END END"
    )
    return f"array_join(transform({tokens_sql(text)}, t -> {one}), '')"


def py_repr_sql(v: str, k: str | None = None) -> str:
    """Python ``repr(x)`` of a VARIANT (strings quoted)."""
    k = k or f"({json_kind_sql(v)})"
    return f"CASE WHEN {k} = 'str' THEN {py_repr_str_sql(_typed(v, 'string'))} ELSE {py_text_sql(v, k)} END"


def py_float_of_sql(v: str, k: str | None = None) -> str:
    """Python ``float(x)`` of a VARIANT: numbers, bools, numeric strings; NULL otherwise."""
    k = k or f"({json_kind_sql(v)})"
    return (
        f"CASE WHEN {k} IN ('int', 'float') THEN {double_sql(v)} "
        f"WHEN {k} = 'bool' THEN CAST({_typed(v, 'boolean')} AS DOUBLE) "
        f"WHEN {k} = 'str' THEN {py_float_sql(_typed(v, 'string'))} END"
    )


def text_list_sql(v: str) -> str:
    """A JSON array as ``array<string>`` with ``str()`` applied to each element."""
    return f"transform({_typed(v, 'array<variant>')}, e -> {py_text_sql('e')})"


def object_keys_sql(v: str) -> str:
    return f"map_keys({_typed(v, 'map<string,variant>')})"


def with_json_verdict(df: DataFrame, text: str, kind: str = "kind", error: str = "error") -> DataFrame:
    """Adds the Python type name of the JSON in column ``text`` and, where it is none, the decoder's message.

    A null text has neither. The type of an empty text is null, its message ``Expecting value``.
    """
    parsed = with_strict_json(df, f"`{text}`", "__json")
    # a generator that filters on the verdict cannot cross, so that a text is parsed once
    why = f"CASE WHEN __json IS NULL THEN {json_error_text_sql(strip_sql(f'`{text}`'))} END"
    found = F.inline(F.array(F.struct(F.expr(json_kind_sql("__json")).alias(kind), F.expr(why).alias(error))))
    return parsed.select(*df.columns, found)


# Column forms -------------------------------------------------------------


def vget(v: str, path: str) -> Column:
    return F.expr(vget_sql(_e(v), path))


def present(v: str, path: str) -> Column:
    return F.expr(f"{vget_sql(_e(v), path)} IS NOT NULL")


def is_json_null(v: str) -> Column:
    return F.expr(is_json_null_sql(_e(v)))


def json_kind(v: str) -> Column:
    return F.expr(json_kind_sql(_e(v)))


def py_text(v: str) -> Column:
    return F.expr(py_text_sql(_e(v)))


def py_repr(v: str) -> Column:
    return F.expr(py_repr_sql(_e(v)))


def py_float_of(v: str) -> Column:
    return F.expr(py_float_of_sql(_e(v)))


def text_list(v: str) -> Column:
    return F.expr(text_list_sql(_e(v)))


def object_keys(v: str) -> Column:
    return F.expr(object_keys_sql(_e(v)))
