import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalgrid.llm import simhash
from evalgrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text, k):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, r):
    """Smallest node reached, of a list of values."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É é\xa0x y", "w " * 300]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "f\tg"]) for _ in range(n)) for n in (2, 3, 4, 5, 50, 400)]
    for k in (1, 3, 5):
        assert [simhash.fingerprint(t, k) for t in texts] == [brute_fingerprint(t, k) for t in texts]


def test_spark_has_the_same_hash(spark):
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == simhash.fingerprint("a b c", 3)


def signed(values):
    return [(v - (1 << 64) if v >> 63 else v,) for v in values]


def linked_alike(spark, fps, r, hot):
    got = connected_components(simhash.links(spark.createDataFrame(signed(fps), "fp long"), r, hot)).collect()
    got = {x.node % (1 << 64): x.component % (1 << 64) for x in got}
    first = {}
    for f, c in zip(fps, brute_components(fps, r)):
        g = got.get(f, f)
        # one found component to one true one, and back
        assert first.setdefault(("true", c), g) == g and first.setdefault(("found", g), c) == c


# hot 64: fetched by segments; 0: all by whole values; 3: some by each
@pytest.mark.parametrize("r,hot", [(0, 64), (1, 64), (2, 64), (3, 64), (1, 3), (2, 3), (3, 3), (2, 0)])
def test_links_match_brute_force(spark, r, hot):
    rng = random.Random(r)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        v = rng.getrandbits(64)
        fps.append(v)
        for _ in range(8):  # chains of changed bits
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            fps.append(v)
    linked_alike(spark, sorted(set(fps)), r, hot)


@pytest.mark.parametrize("hot", [10, 64, 1000])
def test_a_segment_that_many_share(spark, hot):
    rng = random.Random(5)
    # 300 fingerprints with the same low half, some close in the high half; and some a bit off in the low half
    high = [rng.getrandbits(32) for _ in range(100)]
    high += [h ^ 1 << rng.randrange(32) for h in high] + [h ^ 3 << rng.randrange(31) for h in high]
    fps = [h << 32 | 12345 for h in high] + [h << 32 | 12345 ^ 1 << rng.randrange(32) for h in high[:100]]
    linked_alike(spark, sorted(set(fps)), 2, hot)


def test_verification_rejects_what_segments_bring(spark):
    # each pair shares the low half and lies 3 or more bits apart in the high half
    fps = [(7 << 3 * i) << 32 | 99 for i in range(10)] + [99]
    df = spark.createDataFrame(signed(fps), "fp long")
    table = simhash._segments(df)
    fetched = simhash._looked_up(table, 1).withColumnRenamed("fp", "by").join(table, ["segment", "value"]).where("by <> fp")
    assert fetched.count() >= 110
    assert simhash.links(df, 2).collect() == []
    assert simhash.links(df, 3).count() == 10


def test_a_crowded_segment_makes_no_pairs(spark):
    # 100,000 fingerprints share a segment: no more than their whole-value keys are listed
    high = F.shiftrightunsigned(F.xxhash64("id"), 33)
    df = spark.range(100_000).select((high * (1 << 32) + 77).alias("fp")).distinct()
    got = [tuple(x) for x in simhash.links(df, 2).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    fps = [r.fp for r in df.collect()]
    known, want = np.sort(np.array(fps)), []
    for i in range(32, 63):
        for j in range(32, i + 1):  # all share the low half
            other = known ^ (1 << i | 1 << j)
            place = np.minimum(np.searchsorted(known, other), len(known) - 1)
            same = known[place] == other
            want += zip(known[same].tolist(), other[same].tolist())
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    assert want and all(root(a) == root(b) for a, b in want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(1, 50)} | {1000: 1000}


def test_documents(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(400)) for _ in range(6)]
    rows = [(i, base[i % 6] + (f" tail{i}" if i % 4 else ""), "x", None) for i in range(60)]
    rows += [(500 + i, t, None, "y") for i, t in enumerate([None, "", " ", "one", "ONE", "one two"])]
    rows += [(None, base[0], "a", "b"), (None, "alone here", "a", "b"), (7, base[1], "", ""), (7, base[1], "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    roots = brute_components(fps, 2)
    least = {}
    for (d, *_), c in zip(rows, roots):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = [(r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, roots)]
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=order) == sorted(want, key=order)
    kept = simhash.keep_one(df).collect()
    # of each group one row: the smallest key's, or one without a key
    assert len(kept) == len(set(roots)) and kept[0].asDict().keys() == set(df.columns)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted((least.get(c) is None, least.get(c, 0)) for c in set(roots))


def test_keep_one_loses_no_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "ab")
    rows = [(5, a), (5, b), (3, b), (8, a), (9, a), (None, "no key one"), (None, "no key one"), (None, None), (None, ""), (4, "c d e"), (4, "c d e")]
    df = spark.createDataFrame([(k, t, f"x{i}", None) for i, (k, t) in enumerate(rows)], SCHEMA).repartition(3)
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.keep_one(df).collect()), key=repr)
    assert kept == sorted([(5, a), (3, b), (None, "no key one"), (None, ""), (4, "c d e")], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == simhash.keep_one(df).collect() == []
