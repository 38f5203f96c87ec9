"""Importance resampling: CRC-32 by position tables against zlib, draws against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalgrid.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_features(text, max_n=1):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least_words=20, max_n=1, buckets=10_000, seed="2024"):
    """(key, n_features, weight, score, rank) of each (key, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for of, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in brute_features(x, max_n)[1]:
                of[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, x in docs:
        n_words, fs = brute_features(x, max_n)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    rank = {id(r): i + 1 for i, r in enumerate(drawn)}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_crc_of_spans_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    size = np.concatenate([rng.integers(1, 300, 400), [1, 63, 64, 65, 127, 128, 129, 4096, 200_001]])
    start = rng.integers(0, len(data) - size + 1)
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size)]
    assert resampling.span_crc32(data, start, start + size).tolist() == want
    assert resampling.span_crc32(data, start, start + 9).tolist() == [zlib.crc32(data[a : a + 9].tobytes()) for a in start]
    assert len(resampling.span_crc32(data, start[:0], start[:0])) == 0


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz9 ,\n\x00éÉ中", max_size=200)), max_size=8), st.integers(1, 3))
def test_features_of_texts(texts, max_n):
    found = {i: [] for i in range(len(texts))}
    for lo, words, row, value in resampling.features(pa.array(texts, pa.string()), max_n):
        for i, n in enumerate(words):
            assert n == brute_features(texts[lo + i])[0]
        for i, v in zip(row, value):
            found[lo + i].append(int(v))
    for i, text in enumerate(texts):
        assert sorted(found[i]) == sorted(zlib.crc32(f.encode()) for f in brute_features(text, max_n)[1])


def test_slices_and_long_texts(monkeypatch):
    texts = pa.array(["cut off", "a b c", None, "word " * 5000, "é" * 70_000, "end"])[1:]
    monkeypatch.setattr(resampling, "_BYTES", 1 << 12)
    got = [(lo, words.tolist()) for lo, words, _, _ in resampling.features(texts)]
    assert [lo + i for lo, w in got for i in range(len(w))] == list(range(5))
    assert [n for _, w in got for n in w] == [3, 0, 5000, 1, 1]


def rows_of(spark, docs):
    return spark.createDataFrame([(k, x, 0, "z") for k, x in docs], "doc_id long, text string, n_features int, rank string")


def test_draws_as_the_plain_version(spark):
    docs = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 60))) for i in range(300)] + [(7, "again " * 30), (7, "again " * 30)]
    docs += [(None, None), (None, "no key " * 20), (900, ""), (901, "\n ,"), (902, "Long-" * 40_000)]
    target = ["w1 w2 w3", None, "", "long again"]
    asked = spark.createDataFrame([(x,) for x in target], "text string")
    for percent, max_n in ((10, 1), (100, 2)):
        got = resampling.resample(rows_of(spark, docs), asked, percent=percent, max_n=max_n)
        assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")}
        found = sorted(map(repr, (tuple(r) for r in got.drop("n_words").collect())))
        assert found == sorted(map(repr, brute(docs, target, percent=percent, max_n=max_n)))


def test_ties_go_to_the_smaller_key(spark, monkeypatch):
    # without noise all scores are equal
    plain = resampling.scored
    monkeypatch.setattr(resampling, "scored", lambda *a, **b: plain(*a, **b).withColumn("score", F.lit(5).cast("long")))
    docs = rows_of(spark, [(k, "same words here") for k in (9, 3, None, 5, 3, 1)])
    got = resampling.resample(docs, docs, percent=67, least_words=3).where("rank is not null").orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(1, 1), (2, 3), (3, 3), (4, 5)]


def test_empty_tables_and_no_draw(spark):
    some, none = rows_of(spark, [(1, "a b"), (2, None)]), rows_of(spark, [(1, "x")]).limit(0)
    assert resampling.resample(none, some).collect() == []
    rows = resampling.resample(some, none).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in rows} == {(1, 2, None), (2, 0, None)}
