"""Language profiles against plain counting, and accuracy on held-out rows."""

import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalgrid.llm import language_id as lid


def brute_grams(text):
    if not any(c.isalpha() for c in text):
        return Counter()
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    mark = lambda c: c > "\x7f" and unicodedata.category(c)[0] == "M"
    out = Counter()
    for word in "".join(low(c) if c.isalpha() else c if mark(c) else " " for c in text).split(" "):
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if word and padded[i : i + n] != " ")
    return out


def packed(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def brute_order(counts, size):
    return [packed(g) for g in sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]]


def brute_predict(text, orders, size):
    own = brute_order(brute_grams(text or ""), size)
    if not own or not orders:
        return "und", 0.0
    apart = {}
    for language, order in orders.items():
        place = {g: i for i, g in enumerate(order)}
        apart[language] = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(own))
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (size * len(own))


TEXTS = st.text(alphabet="aB ñ,9\nÉiİяß中́\U0001f600", max_size=120)


@settings(deadline=None)
@given(TEXTS, st.sampled_from([3, 7, 1 << 18]))
def test_gram_counts(text, stretch):
    kept, lid._STRETCH = lid._STRETCH, stretch
    try:
        grams, counts = lid.gram_counts(text)
    finally:
        lid._STRETCH = kept
    assert dict(zip(grams.tolist(), counts.tolist())) == {packed(g): n for g, n in brute_grams(text).items()}


@settings(deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), TEXTS, st.integers(1, 30))
def test_prediction_is_the_least_out_of_place(learnt, text, size):
    orders = {f"l{i}": brute_order(brute_grams(t), size) for i, t in enumerate(learnt) if brute_grams(t)}
    got, want = lid.profiles(orders, size).predict(text), brute_predict(text, orders, size)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"


def test_fit_and_predict_as_the_plain_version(spark):
    texts = {"en": "the cat and the dog were there", "de": "der Hund und die Katze waren da", "xx": "123 !"}
    rows = [(10 * i + k, f"{t} {i}", n, "q", 1) for k, (n, t) in enumerate(texts.items()) for i in range(5)]
    rows += [(rows[0][0], rows[0][1], "en", "q", 1), (None, "die die die", "en", "q", 1), (99, None, "en", "q", 1), (98, "das", None, "q", 1)]
    learnt = [r for r in dict.fromkeys(rows) if r[0] is not None and r[1] is not None and r[2] is not None]
    orders = {}
    for language in ("en", "de"):
        orders[language] = brute_order(sum((brute_grams(r[1]) for r in learnt if r[2] == language), Counter()), lid.PROFILE)
    df = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit_profiles(df)
    assert model.languages == ("de", "en")
    asked = [(1, "the dog"), (2, "die Katze"), (2, "die Katze"), (None, "und und"), (3, None), (4, ""), (5, "12 ;"), (6, "Hund " * 300_000)]
    got = lid.predict_languages(spark.createDataFrame([(k, t, "de", "q", 1) for k, t in asked], SCHEMA), model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    want = [(k, *brute_predict(t, orders, lid.PROFILE)) for k, t in asked]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words", None, "q", 1)], SCHEMA)
    model = lid.fit_profiles(df)
    assert [tuple(r) for r in lid.predict_languages(df, model).collect()] == [(1, "und", 0.0)]
    assert lid.predict_languages(df.limit(0), model).collect() == []


def test_at_most_so_many_rows_of_a_language(spark):
    rows = [(i, 3 * chr(97 + i % 26), "en", "q", 1) for i in range(50)]
    one = lid.fit_profiles(spark.createDataFrame(rows, SCHEMA), rows=1)
    assert len(one.grams) == 7 and sorted(one.places[0]) == list(range(7))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lid.fit_profiles(docs.where(~lid.held_out()))
    judged = lid.predict_languages(docs, model).withColumn("out", lid.held_out()).join(docs.select("doc_id", "lang"), "doc_id")
    rows = [r for r in judged.collect() if r.out and r.lang and r.lang_pred != "und"]
    assert len(rows) > 150
    for language in {r.lang for r in rows}:
        own = [r.lang_pred == language for r in rows if r.lang == language]
        assert sum(own) >= 0.97 * len(own)
