"""Differential tests: the SQL helpers against Python's own str/float/json behaviour.

Each hypothesis example is a batch of values scored in one DataFrame, so a
few examples cover thousands of values without one Spark job per value.
"""

import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalgrid.functions import jsonv, text

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       　"
texty = st.text(alphabet=st.sampled_from(list("ab1.-_eE+ ,{}[]\":nNaIif0") + list(WS)), max_size=12)
floats = st.floats(allow_nan=True, allow_infinity=True, width=64).filter(lambda x: x == 0 or 1e-300 < abs(x) < 1e15 or not math.isfinite(x))


def _py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def _strict(s):
    try:
        v = json.loads(s.strip())
    except ValueError:
        return None
    return type(v).__name__


@SETTINGS
@given(st.lists(texty, min_size=50, max_size=200))
def test_strip_float_json(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = jsonv.with_strict_json(df, "s", "v").select(
        "i", "s", text.py_strip("s").alias("strip"), text.py_float("s").alias("f"), jsonv.json_kind("v").alias("kind"),
    ).collect()
    for r in out:
        assert r.strip == r.s.strip(), repr(r.s)
        want = _py_float(r.s)
        if want is None or math.isnan(want):
            assert (r.f is None) == (want is None), repr(r.s)
        else:
            assert r.f == want, repr(r.s)
        want_kind = _strict(r.s)
        assert r.kind == want_kind, repr(r.s)


@SETTINGS
@given(st.lists(floats, min_size=50, max_size=200))
def test_float_repr_and_fixed(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    out = df.select("x", text.float_repr("x").alias("r"), text.fixed("x", 2).alias("f2"), text.fixed("x", 4).alias("f4")).collect()
    for r in out:
        assert r.r == repr(r.x), r.x
        assert r.f2 == f"{r.x:.2f}" and r.f4 == f"{r.x:.4f}", r.x


def test_fixed_rounds_like_python(spark):
    from evalgrid.functions.text import fixed

    values = [0.0005, 0.5005, 0.0015, 2.675, 0.00049999, -0.0004, -0.0006, 0.0, 1e-9, 0.5, 0.05, 0.005, 1.005, 0.125, 0.00025, 0.05000001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(fixed("x", n)).collect()]
        assert got == [f"{v:.{n}f}" for v in values]


def test_strip_is_linear_and_nested_text_is_pythons(spark):
    import json
    import time

    from pyspark.sql import functions as F

    from evalgrid.functions.jsonv import py_nested_sql
    from evalgrid.functions.text import py_strip

    long = "x" + " " * 1_000_000 + "y"
    df = spark.createDataFrame([(f" {long}\x1f",)], "s string")
    df.select(py_strip("s")).collect()
    start = time.time()
    assert df.select(py_strip("s")).first()[0] == long and time.time() - start < 5
    nested = [[1, 2], {"a": [1.5, None, True, "it's"], "b": {"c": "q\"x\\y"}}, [], [[1e20, 1e-7, "[,]"]]]
    texts = spark.createDataFrame([(json.dumps(v, separators=(",", ":")),) for v in nested], "t string")
    assert [r[0] for r in texts.select(F.expr(py_nested_sql("t"))).collect()] == [str(v) for v in nested]
