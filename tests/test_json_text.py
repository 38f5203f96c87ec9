"""JSON texts token by token: the decoder's messages, one strict parse, members in document order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalgrid.functions import jsontext, jsonv
from evalgrid.operators import scorers as S

BROKEN = [
    "", "{", "[", "}", "]", "not json", "{bad}", '{"bad": }', '{"id": "x", "bad": [],}', '{"id": "x", "description": "unfinished"',
    "[1,]", "[1,,2]", "[1 ,\n]", '{"a":1} trailing', "1 2", '"abc', '"a\\', '"a\\u12', '"a\\u1234', '"a\\u1234x', '"a\\u1234\\n', '"a\\q"',
    '"a\tb"', '{"a" 1}', '{"a":1 "b":2}', "{1:2}", "{'a':1}", "-", "-x", "01", "1.", "1e", "tru", "nul", "NaNx", "[NaN, -Infinity",
    "-Infinit", "﻿{}", '{"a":\n 1,\n\n x}', '{"a":"\\ud83d\\u12"}', '"\\\\u1234', '"\\\\\\u1234', "{,}", '{"a":1,,}', "[,1]",
    ":", ",", '"\\ud83d\\ude0', '"x\\ud83d"x', "truefalse", "[1 2]", '{"a":[}', '{"a":{]', "  \n x", "é", '["\U0001f600", x]',
]
WHOLE = [
    '{"id": "t1", "a": [1, 2.5, -3e4, null, true, {"b": "x\\\\y\\"z é中\U0001f600\\n\\ud83d"}], "c": {}}',
    '[[], {}, [{"k": [1]}], "stré", {"x": {"y": [[["deep"]]]}}, NaN, -Infinity]',
]


def message(text):
    try:
        json.loads(text)
    except json.JSONDecodeError as e:
        return str(e)


def mutated(seed, n):
    """Cut, changed and random texts that are no JSON."""
    rnd, alphabet = random.Random(seed), '{}[]:,"\\ \n\tu0a1-.eEtrfnNIé\U0001f600'
    for _ in range(n):
        t = list(rnd.choice(WHOLE))
        if rnd.random() < 0.3:
            del t[rnd.randrange(len(t)) :]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(alphabet) * rnd.randrange(2)
        yield "".join(t)
        yield "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))


def test_messages_are_the_decoders(spark):
    texts = [t for t in [*BROKEN, *mutated(11, 1500)] if message(t) is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: r.m for r in df.select("i", jsontext.json_error_text("s").alias("m")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, message(t)) for t in texts]


def test_whole_texts_have_no_message(spark):
    df = spark.createDataFrame([(t,) for t in WHOLE], "s string")
    assert [r.m for r in df.select(jsontext.json_error_text("s").alias("m")).collect()] == [None, None]


def test_long_texts(spark):
    # no recursion over characters, escapes or tokens
    long = '{"a": "' + 'x\\n"'[:-1] * 200_000 + '", "b": [' + "1, " * 20_000 + "NaN]"
    texts = [long + "}", long + "} x", long, "prose " * 200_000, '"' + "\\\\" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = jsonv.with_json_verdict(df, "s").select("i", "kind", "error").orderBy("i").collect()
    assert [(r.kind, r.error) for r in rows] == [("dict", None), *((None, message(t.strip())) for t in texts[1:])]


def test_one_parse_takes_whole_values_only(spark):
    texts = ["1", "", "[]", "1]", "1],[2", "1,2", "1,0]", '{"a":1}', '{"a":1} x', ' "x" ', "NaN", "-Infinity", "-NaN", '[NaN, "NaN", Infinity]',
             "nan", "NaN 1", "null", "1e999", "-0", '{"a": 1, "a": 2}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = jsonv.with_strict_json(df, "s", "v").select("i", "s", jsonv.json_kind("v").alias("k"), jsonv.py_text("v").alias("t"), "v").orderBy("i").collect()
    for r in rows:
        try:
            want = json.loads(r.s.strip())
        except ValueError:
            assert r.v is None and r.k is None, r.s
            continue
        assert r.k == type(want).__name__, r.s
        if not isinstance(want, (list, dict)):
            assert r.t == str(want), r.s


def test_members_in_document_order(spark):
    texts = ['{"x": {"e": 0}, "e": {"b": [1.50, -0], "a": {"e": 1}}, "z": 1}', '{"e": 1, "e" : [ 2 ]}', '{"a": "e", "b": ["e", 3]}',
             '{"\\u0065": "q:,}"}', "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r.m for r in df.select("i", jsontext.member_text("s", "e").alias("m")).orderBy("i").collect()]
    assert got == ['{"b":[1.50,-0],"a":{"e":1}}', "[2]", None, '"q:,}"', None]


@pytest.mark.parametrize(
    ("task", "response"),
    [('{"expected_tool": "a"}', '{"tool": {"z": 1, "b": [1.0, NaN, "it\'s"]}}'), ('{"metadata": {"expected_tool": {"z": 1, "b": 2}}}', '{"tool": 3}')],
)
def test_nested_tools_print_as_python(spark, task, response):
    df = spark.createDataFrame([(task, response)], "line string, response string").withColumn("task", F.parse_json("line"))
    scored = S.score_frame(S.with_task_spec(df, text="line"), scorer="json_valid").first().result
    t, r = json.loads(task), json.loads(response)
    want = t.get("expected_tool", t.get("metadata", {}).get("expected_tool"))
    assert scored.reason == f"JSON parsed successfully; Tool mismatch: expected '{want}', got '{r['tool']}'"


def brute_beginning(text):
    """The longest beginning that its open brackets, closed, make JSON."""
    for end in range(len(text), 0, -1):
        begun, stack, quoted, escaped = text[:end], [], False, False
        if begun[-1] in " \t\n\r":
            continue
        for c in begun:
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        closed = begun + "".join(reversed(stack))
        try:
            json.loads(closed)
            return closed
        except ValueError:
            pass
    return None


def test_beginnings_match_brute_force(spark):
    import random

    from evalgrid.functions.jsontext import json_beginning

    rng = random.Random(4)
    whole = [
        '{"id": "a\\"b{", "n": [1, -2.5e3, {"x": null}], "t": {"u": [true, false]}}', '[[], {}, [[["deep"]]], "\\u00e9"]',
        ' {"a":NaN,"b":-Infinity}', '"text"', "12.50", "{}", '{"é": "中"}',
    ]
    texts = [None, "", " ", "prose", "{", "[", '{"a"', '{"a":', "[1,", "[1,]", '{"a": 1,}', '{"a": tru', "1 2", "{} {}", "nul", '{"a": "x\ny"}', "]", "-"]
    texts += [w[:i] for w in whole for i in range(len(w) + 1)]
    for w in whole * 15:  # one character changed, put in or taken out
        i = rng.randrange(len(w))
        texts.append(w[:i] + rng.choice(["", '"', "}", "]", ",", ":", "0", w[i] * 2]) + w[i + 1 :])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", json_beginning("text").alias("saved"))
    got = {r.i: r.saved for r in df.collect()}
    wrong = [(t, got[i], brute_beginning(t)) for i, t in enumerate(texts) if t is not None and got[i] != brute_beginning(t)]
    assert wrong == [] and got[0] is None


def test_error_records(spark):
    from evalgrid.sources.tasks import error_records

    lines = [
        '{"id": "a", "description": "d", "expected_output": "e"}', "  ", ' {"id": "b", "description": "cut he', "[1, 2", "[1, 2]",
        '{"id": 3}', '{"id": "c", "description": "", "expected_output": "e"} ', "prose",
    ]
    df = spark.createDataFrame([("f", i + 1, t, "x") for i, t in enumerate(lines)], "task_file string, line_no long, line string, details string")
    got = {r.line: (r.error_type, r.details.asDict(), r.task_partial) for r in error_records(df).collect()}
    none = {"char": None, "kind": None, "field": None, "missing": None}
    assert got == {
        3: ("parsing", none | {"char": 27}, '{"id": "b"}'),
        4: ("parsing", none | {"char": 5}, None),
        5: ("not_object", none | {"kind": "list"}, None),
        6: ("validation", none | {"field": "required_fields", "missing": ["description", "expected_output"]}, '{"id": 3}'),
        7: ("validation", none | {"field": "description"}, '{"id": "c", "description": "", "expected_output": "e"}'),
        8: ("parsing", none | {"char": 0}, None),
    }
    assert error_records(df.where("false")).collect() == []
