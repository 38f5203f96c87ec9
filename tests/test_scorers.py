"""Scorer case tables: (task JSON, response) -> (score, passed, reason)."""

import pytest
from pyspark.sql import functions as F

from evalgrid.operators import scorers as S

NONE = None

EXACT = [
    ('{"expected": "hello"}', "hello", 1.0, True, "Matched expected answer"),
    ('{"expected": "Hello"}', "hello", 1.0, True, "Matched expected answer"),
    ('{"expected": "  hello  "}', "hello", 1.0, True, "Matched expected answer"),
    ('{"expected": "hello"}', "　hello\t\n", 1.0, True, "Matched expected answer"),
    ('{"expected": "hello"}', "world", 0.0, False, "Expected 'hello' but got 'world'"),
    ('{"expected": " Hi "}', " HELLOO ", 0.0, False, "Expected 'Hi' but got 'HELLOO'"),
    ('{"expected": "a  b"}', "a b", 0.0, False, "Expected 'a  b' but got 'a b'"),
    ("{}", "hello", 0.0, False, "Task is missing 'expected' or 'expected_output' key"),
    ('{"expected_output": "hello"}', "hello", 1.0, True, "Matched expected answer"),
    ('{"expected": null, "expected_output": "x"}', "x", 0.0, False, "Task 'expected' value is None"),
    ('{"expected_output": null}', "x", 0.0, False, "Task 'expected_output' value is None"),
    ('{"expected": "hello"}', NONE, 0.0, False, "Response is None"),
    ('{"expected": ""}', "   ", 1.0, True, "Matched expected answer"),
    ('{"expected": 42}', "42", 1.0, True, "Matched expected answer"),
    ('{"expected": true}', "TRUE", 1.0, True, "Matched expected answer"),
    ('{"expected": 2.50}', "2.5", 1.0, True, "Matched expected answer"),
]

NUMERIC = [
    ('{"expected": 4}', "The answer is 4", 1.0, True, "Value 4.0 within tolerance 0.01 of expected 4.0"),
    ('{"expected": "3.14"}', "about 3.145 maybe", 1.0, True, "Value 3.145 within tolerance 0.01 of expected 3.14"),
    ('{"expected": 10, "tolerance": 0.5}', "10.4", 1.0, True, "Value 10.4 within tolerance 0.5 of expected 10.0"),
    ('{"expected": 10, "tolerance": 0.5}', "11", 0.0, False, "Expected 10.0 (±0.5) but got 11.0"),
    ('{"expected": -5}', "a-5 b", 1.0, True, "Value -5.0 within tolerance 0.01 of expected -5.0"),
    ('{"expected": 1000}', "1,000", 0.0, False, "Expected 1000.0 (±0.01) but got 1.0"),
    ('{"expected": 100000}', "1e5", 0.0, False, "Expected 100000.0 (±0.01) but got 1.0"),
    ('{"expected": 0.5}', ".5 units", 1.0, True, "Value 0.5 within tolerance 0.01 of expected 0.5"),
    ('{"expected": "abc"}', "5", 0.0, False, "Task 'expected' is not numeric: 'abc'"),
    ('{"expected": null}', "5", 0.0, False, "Task 'expected' is not numeric: None"),
    ('{"expected_output": "x\'y"}', "5", 0.0, False, "Task 'expected_output' is not numeric: \"x'y\""),
    ('{"expected": 5}', "no digits here ", 0.0, False, "No number found in response: 'no digits here'"),
    ('{"expected": 5, "tolerance": "wide"}', "5", 0.0, False, "Task 'tolerance' is not numeric: 'wide'"),
    ('{"expected": 5, "tolerance": "1"}', "5.5", 1.0, True, "Value 5.5 within tolerance 1.0 of expected 5.0"),
    ('{"expected": "nan"}', "5", 0.0, False, "Expected nan (±0.01) but got 5.0"),
    ('{"expected": 5, "tolerance": "nan"}', "5", 0.0, False, "Expected 5.0 (±nan) but got 5.0"),
    ('{"expected": 12345678}', "12345678", 1.0, True, "Value 12345678.0 within tolerance 0.01 of expected 12345678.0"),
    ('{"expected": 0.00001, "tolerance": 0.000001}', "0.00001", 1.0, True, "Value 1e-05 within tolerance 1e-06 of expected 1e-05"),
    ('{"expected": true}', "1", 1.0, True, "Value 1.0 within tolerance 0.01 of expected 1.0"),
    ('{}', "1", 0.0, False, "Task is missing 'expected' or 'expected_output' key"),
    ('{"expected": 1}', NONE, 0.0, False, "Response is None"),
]

KEYWORD = [
    ('{"expected_keywords": ["python", "java"]}', "I like Python and JAVA", 1.0, True, "Matched 2/2 keywords (threshold=0.7)"),
    ('{"expected_keywords": ["a", "zz", "zz"]}', "abc", 1 / 3, False, "Matched 1/3 keywords (threshold=0.7); missing: zz, zz"),
    ('{"expected_keywords": ["a", "b", "c", "d"]}', "a b c", 0.75, True, "Matched 3/4 keywords (threshold=0.7)"),
    ('{"expected_keywords": ["a", "b"], "threshold": 1}', "a", 0.5, False, "Matched 1/2 keywords (threshold=1); missing: b"),
    ('{"expected_keywords": []}', "anything", 1.0, True, "No keywords required"),
    ('{"expected_keywords": null, "metadata": {"keywords": ["x"]}}', "x", 1.0, True, "Matched 1/1 keywords (threshold=0.7)"),
    ('{"metadata": {"keywords": [42, "py"]}}', "py 42", 1.0, True, "Matched 2/2 keywords (threshold=0.7)"),
    ("{}", "x", 0.0, False, "Task is missing 'expected_keywords' or 'metadata.keywords' key"),
    ('{"expected_keywords": "abc"}', "abc", 0.0, False, "Task keywords ('expected_keywords' or 'metadata.keywords') is not a list: str"),
    ('{"expected_keywords": {"a": 1}}', "abc", 0.0, False, "Task keywords ('expected_keywords' or 'metadata.keywords') is not a list: dict"),
    ('{"expected_keywords": ["a"], "threshold": "hi"}', "a", 0.0, False, "Task 'threshold' is not numeric: 'hi'"),
    ('{"expected_keywords": [""]}', "", 1.0, True, "Matched 1/1 keywords (threshold=0.7)"),
    ('{"expected_keywords": ["x"]}', NONE, 0.0, False, "Response is None"),
]

JSON = [
    ('{}', '{"a": 1}', 1.0, True, "JSON parsed successfully"),
    ('{}', '  {"a": 1}  ', 1.0, True, "JSON parsed successfully"),
    ('{}', '{"a": 1} trailing', 0.0, False, "Invalid JSON: Extra data: line 1 column 10 (char 9)"),
    ('{}', 'not json', 0.0, False, "Invalid JSON: Expecting value: line 1 column 1 (char 0)"),
    ('{}', '[1, 2]', 0.0, False, "JSON parsed but result is list, expected object"),
    ('{}', '"s"', 0.0, False, "JSON parsed but result is str, expected object"),
    ('{}', '3.5', 0.0, False, "JSON parsed but result is float, expected object"),
    ('{"expected_tool": "search"}', '{"tool": "search"}', 1.0, True, "JSON parsed successfully; Tool matches: 'search'"),
    ('{"expected_tool": "search"}', '{"tool": "calc"}', 0.5, False, "JSON parsed successfully; Tool mismatch: expected 'search', got 'calc'"),
    ('{"expected_tool": "search"}', '{"x": 1}', 0.5, False, "JSON parsed successfully; Missing 'tool' key (expected 'search')"),
    ('{"expected_tool": 1}', '{"tool": "1"}', 0.5, False, "JSON parsed successfully; Tool mismatch: expected '1', got '1'"),
    ('{"expected_tool": 1}', '{"tool": 1.0}', 1.0, True, "JSON parsed successfully; Tool matches: '1'"),
    ('{"metadata": {"expected_tool": "s", "required_argument_keys": ["q"]}}', '{"tool": "s", "arguments": {"q": null}}', 1.0, True,
     "JSON parsed successfully; Tool matches: 's'; All required argument keys present: q"),
    ('{"required_argument_keys": ["q", "n"]}', '{"arguments": {"q": 1}}', 0.5, False, "JSON parsed successfully; Missing argument keys: n"),
    ('{"required_argument_keys": ["q"], "expected_tool": "s"}', '{"tool": "x", "arguments": {}}', 0.3333, False,
     "JSON parsed successfully; Tool mismatch: expected 's', got 'x'; Missing argument keys: q"),
    ('{"required_argument_keys": ["q"], "expected_tool": "s"}', '{"tool": "s", "arguments": {"q": 2}}', 1.0, True,
     "JSON parsed successfully; Tool matches: 's'; All required argument keys present: q"),
    ('{"required_argument_keys": ["q"], "expected_tool": "s"}', '{"tool": "s"}', 0.6667, False,
     "JSON parsed successfully; Tool matches: 's'; Missing 'arguments' key in response"),
    ('{"required_argument_keys": ["q"]}', '{"arguments": [1]}', 0.5, False, "JSON parsed successfully; 'arguments' is not an object: list"),
    ('{"required_argument_keys": "q"}', '{"arguments": {"q": 1}}', 0.5, False, "JSON parsed successfully; 'required_argument_keys' is not a list: str"),
    ('{"required_argument_keys": []}', '{"arguments": {}}', 1.0, True, "JSON parsed successfully; All required argument keys present: "),
    ('{"required_argument_keys": [1]}', '{"arguments": {"1": 0}}', 0.5, False, "JSON parsed successfully; Missing argument keys: 1"),
    ('{"expected_tool": null, "metadata": {"expected_tool": "s"}}', '{"tool": "x"}', 1.0, True, "JSON parsed successfully"),
    ('{}', NONE, 0.0, False, "Response is None"),
]


def _run(spark, name, cases):
    rows = [(i, c[0], c[1]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, task string, response string").withColumn("task", F.parse_json("task"))
    out = S.score_tasks(df, scorer=name, out="r").orderBy("i").collect()
    return [(r.r.score, r.r.passed, r.r.reason) for r in out]


ALL = {"exact_match": EXACT, "numeric_close": NUMERIC, "keyword_match": KEYWORD, "json_valid": JSON}


@pytest.mark.parametrize("name", sorted(ALL))
def test_scorer_cases(spark, name):
    cases = ALL[name]
    got = _run(spark, name, cases)
    for case, (score, passed, reason) in zip(cases, got):
        assert reason == case[4], (case, reason)
        assert passed is case[3], case
        assert score == pytest.approx(case[2]), case


def test_dispatch_by_category(spark):
    df = spark.createDataFrame(
        [
            (0, '{"expected_output": "a", "metadata": {"category": "text"}}', "A"),
            (1, '{"expected_output": "5", "metadata": {"category": "math"}}', "it is 5.001"),
            (2, '{"expected_output": "x", "metadata": {"category": "json"}}', "{}"),
            (3, '{"expected_output": "x", "metadata": {"category": "code", "keywords": ["def"]}}', "def f()"),
            (4, '{"expected_output": "x", "metadata": {"category": "Math"}}', "x"),
            (5, '{"expected_output": "x", "metadata": null}', "x"),
            (6, '{"expected_output": "x", "metadata": {"category": ["math"]}}', "x"),
        ],
        "i int, task string, response string",
    ).withColumn("task", F.parse_json("task"))
    tagged = S.with_task_spec(df).withColumn("sc", F.col("spec_scorer"))
    tagged = tagged.drop(*[c for c in tagged.columns if c.startswith("spec_")])
    out = S.score_tasks(tagged, out="r").orderBy("i").collect()
    assert [r.sc for r in out] == ["exact_match", "numeric_close", "json_valid", "keyword_match", "exact_match", "exact_match", "exact_match"]
    assert all(r.r.passed for r in out), [r.r for r in out]


def test_unknown_scorer_in_data(spark):
    df = spark.createDataFrame([("{}", "x")], "task string, response string").withColumn("task", F.parse_json("task"))
    out = S.score_tasks(df, scorer="nope", out="r").collect()
    assert out[0].r.reason == "Unknown scorer: 'nope'. Supported: exact_match, json_valid, keyword_match, numeric_close"
    assert out[0].r.score == 0.0 and out[0].r.passed is False


def test_get_scorer_unknown_raises():
    with pytest.raises(ValueError, match="Unknown scorer: 'x'. Supported: exact_match, json_valid, keyword_match, numeric_close"):
        S.get_scorer("x")


def test_json_error_detail(spark):
    df = spark.createDataFrame([(0, "{}", "not json"), (1, "{}", '{"a": 1} x'), (2, "{}", '{"a": 1}')],
                               "i int, task string, response string").withColumn("task", F.parse_json("task"))
    spec = S.with_task_spec(df, out="spec")
    out = S.score_frame(spec, scorer="json_valid").orderBy("i").collect()
    assert [r.result.reason for r in out] == [
        "Invalid JSON: Expecting value: line 1 column 1 (char 0)",
        "Invalid JSON: Extra data: line 1 column 10 (char 9)",
        "JSON parsed successfully",
    ]


def test_without_reason_same_scores(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(NUMERIC + KEYWORD + JSON)]
    df = spark.createDataFrame(rows, "i int, task string, response string").withColumn("task", F.parse_json("task"))
    spec = S.with_task_spec(df, out="spec")
    full = {r.i: r.result for r in S.score_frame(spec).collect()}
    bare = {r.i: r.result for r in S.score_frame(spec, with_reason=False).collect()}
    assert all(bare[i].reason is None for i in bare)
    assert {i: (r.score, r.passed) for i, r in full.items()} == {i: (r.score, r.passed) for i, r in bare.items()}
