"""Expressions that give Spark Python's text semantics.

Each helper has a ``*_sql`` form that returns Spark SQL expression text over
an input expression, and a Column form (``F.expr`` of that text). Building
the text in Python and handing it to Spark once keeps DataFrame
construction cheap (one JVM call per column instead of one per function).
All of it runs JVM side, inside whole-stage codegen; nothing runs Python
per row.
"""

from __future__ import annotations

import sys
import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as a Java
# regex class (\s covers tab/LF/VT/FF/CR/space; \p{Z} the Unicode separators).
PY_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
# The same characters one by one, for trimming; float() does not strip U+001C..U+001F.
FLOAT_STRIPPED = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
STRIPPED = FLOAT_STRIPPED + "\x1c\x1d\x1e\x1f"

# Fixed value: the numeric_close pattern for "first number in the response"
# (integers, decimals, optional leading minus; no exponent, no separators).
FIRST_NUMBER_RE = r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"

# What Python's float() accepts for a stripped string: decimal with optional
# underscores between digits, optional exponent, or inf/infinity/nan.
PY_FLOAT_RE = (
    r"(?i)^[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:e[+-]?[0-9](?:_?[0-9])*)?|inf|infinity|nan)$"
)


def raw(s: str) -> str:
    """A Spark SQL raw string literal (no escape processing)."""
    assert "'" not in s
    return f"r'{s}'"


def lit(s: str) -> str:
    """A Spark SQL string literal with quotes and backslashes escaped."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill_sql(template: str, /, **parts: str) -> str:
    """SQL ``concat`` of a text template whose ``{placeholder}`` slots are SQL expressions."""
    import re

    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                out.append(lit(piece))
        else:
            out.append(parts[piece])
    return out[0] if len(out) == 1 else "concat(" + ", ".join(out) + ")"


def trim_sql(x: str, characters: str) -> str:
    """Both ends trimmed in one walk from each end, however long inner runs are."""
    codes = "".join(f"\\u{ord(c):04x}" for c in characters)
    return f"btrim({x}, '{codes}')"


def strip_sql(x: str) -> str:
    return trim_sql(x, STRIPPED)


# Decimal digits of all scripts, which Python's \\d and float() take, and their values.
_DIGITS = {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}


def ascii_digits_sql(x: str) -> str:
    """``x`` with every decimal digit in its ASCII form."""
    return f"CASE WHEN {x} RLIKE r'[^\\x00-\\x7F]' THEN translate({x}, '{''.join(_DIGITS)}', '{''.join(_DIGITS.values())}') ELSE {x} END"


def first_number_sql(x: str) -> str:
    return f"regexp_substr({ascii_digits_sql(x)}, {raw(FIRST_NUMBER_RE)})"


def py_float_sql(x: str) -> str:
    """Python ``float(str)``; NULL where Python raises.

    ``try_cast`` alone is too lenient (``1f``, ``0x10p0``, ``1.0d``) and too
    strict (``1_000``); the regex guard keeps Python's grammar.
    """
    s = f"({ascii_digits_sql(trim_sql(x, FLOAT_STRIPPED))})"
    return (
        f"CASE WHEN NOT ({s} RLIKE {raw(PY_FLOAT_RE)}) THEN CAST(NULL AS DOUBLE) "
        f"WHEN lower({s}) RLIKE r'^[+-]?nan$' THEN CAST('NaN' AS DOUBLE) "
        f"ELSE try_cast(replace({s}, '_', '') AS DOUBLE) END"
    )


def float_repr_sql(x: str) -> str:
    """Python ``repr(float)``.

    Spark prints scientific notation outside [1e-3, 1e7) as ``1.0E-5``;
    Python switches outside [1e-4, 1e16) and writes ``1e-05``. The digits are
    the same shortest round-trip digits, so only the layout changes: plain
    ranges through an exact decimal cast of the text, the scientific range by
    rewriting mantissa and exponent.
    """
    d = f"CAST({x} AS DOUBLE)"
    s = f"CAST({d} AS STRING)"

    def plain(scale: int) -> str:
        return f"regexp_replace(regexp_replace(CAST(CAST({s} AS DECIMAL(38,{scale})) AS STRING), '0+$', ''), r'\\.$', '.0')"

    sci = f"regexp_replace({s}, r'\\.0E', 'E')"
    sci = f"regexp_replace({sci}, r'E(-?)([0-9])$', 'E$10$2')"
    sci = f"regexp_replace(regexp_replace({sci}, 'E-', 'e-'), 'E', 'e+')"
    return (
        f"CASE WHEN isnan({d}) THEN 'nan' WHEN {d} = double('inf') THEN 'inf' WHEN {d} = double('-inf') THEN '-inf' "
        f"WHEN NOT contains({s}, 'E') THEN {s} "
        f"WHEN abs({d}) >= 1e7 AND abs({d}) < 1e16 THEN {plain(12)} "
        f"WHEN abs({d}) >= 1e-4 AND abs({d}) < 1e-3 THEN {plain(25)} "
        f"ELSE {sci} END"
    )


def fixed_sql(x: str, decimals: int) -> str:
    """Python ``f"{x:.Nf}"``: round-half-even on the binary value.

    Below one unit of the last place the JVM's formatter judges a tie by the
    shortest digits, so there the double is compared with the half itself.
    """
    d = f"CAST({x} AS DOUBLE)"
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    unit, half = f"1e-{decimals}", f"5e-{decimals + 1}"
    up = ">=" if Decimal(float(half)) > Decimal(half) else ">"
    small = (
        f"concat(CASE WHEN startswith(CAST({d} AS STRING), '-') THEN '-' ELSE '' END, "
        f"CASE WHEN abs({d}) {up} {half}D THEN '{1 / 10**decimals:.{decimals}f}' ELSE '{0:.{decimals}f}' END)"
    )
    return (
        f"CASE WHEN isnan({d}) THEN 'nan' WHEN {d} = double('inf') THEN 'inf' WHEN {d} = double('-inf') THEN '-inf' "
        f"WHEN abs({d}) < {unit}D THEN {small} "
        f"ELSE format_number({d}, '{pattern}') END"
    )


def py_repr_str_sql(x: str) -> str:
    """Python ``repr(str)``: single quotes unless the text has ' and no "."""
    esc = f"replace(replace(replace(replace({x}, '\\\\', '\\\\\\\\'), '\\n', '\\\\n'), '\\r', '\\\\r'), '\\t', '\\\\t')"
    return (
        f"CASE WHEN contains({x}, '\\'') AND NOT contains({x}, '\"') THEN concat('\"', {esc}, '\"') "
        f"ELSE concat('\\'', replace({esc}, '\\'', '\\\\\\''), '\\'') END"
    )


def _e(x) -> str:
    if isinstance(x, str):
        return x
    raise TypeError("pass a column name or SQL expression text")


def py_strip(x: str) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.expr(strip_sql(_e(x)))


def py_is_blank(x: str) -> Column:
    return F.expr(f"{strip_sql(_e(x))} = ''")


def first_number(x: str) -> Column:
    return F.expr(first_number_sql(_e(x)))


def py_float(x: str) -> Column:
    return F.expr(py_float_sql(_e(x)))


def float_repr(x: str) -> Column:
    return F.expr(float_repr_sql(_e(x)))


def fixed(x: str, decimals: int) -> Column:
    return F.expr(fixed_sql(_e(x), decimals))


def py_repr_str(x: str) -> Column:
    return F.expr(py_repr_str_sql(_e(x)))
