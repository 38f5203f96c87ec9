import hashlib
import random
from collections import Counter
from math import log2

import numpy as np
import pytest

from evalgrid.llm import digests
from evalgrid.llm.digests import CLASSES, WINDOW

SCHEMA = "doc_id long, text string, range string, follows string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(n))


def brute_entropy(window):
    return -sum(c / WINDOW * log2(c / WINDOW) for c in Counter(window).values())


def test_entropy_classes_match_brute_force():
    rng = random.Random(2)
    for raw in (b"", b"x" * 63, b"x" * 300, bytes(range(256)) * 2, prose(rng, 200).encode(), (b"a" * 70 + b"b") * 5):
        got = digests.entropy_classes(np.frombuffer(raw, np.uint8))
        want = [brute_entropy(raw[i : i + WINDOW]) / 6 * (CLASSES - 1) for i in range(len(raw) - WINDOW + 1)]
        assert len(got) == len(want) and all(abs(g + 0.5 - w) <= 0.51 for g, w in zip(got, want))


def brute_selected(rank):
    wins, n = Counter(), len(rank)
    run = min(digests.RUN, n)
    for i in range(n - run + 1):
        wins[min(range(i, i + run), key=lambda j: (rank[j], j))] += 1
    least = min(digests.POPULAR, n - run + 1)
    return [j for j in sorted(wins) if wins[j] >= least and rank[j] < CLASSES]


def test_selection_matches_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 500):
        rank = rng.integers(0, 40, n)
        assert digests._selected(rank).tolist() == brute_selected(rank.tolist())
    raw = np.frombuffer(prose(random.Random(1), 900).encode(), np.uint8)
    rank = digests.ranks(np.bincount(digests.entropy_classes(raw), minlength=CLASSES))
    whole = digests.select(raw, rank).tolist()
    monkeypatch.setattr(digests, "_STRETCH", 700)
    assert digests.select(raw, rank).tolist() == whole and len(whole) > 20
    texts = [raw.tobytes().decode(), "", "short", "x" * 500, prose(random.Random(5), 60)]
    together = digests.digests(texts, rank)
    assert together == [digests.digests([t], rank)[0] for t in texts]


def test_likeness():
    rng = random.Random(6)
    a, b = prose(rng, 2000), prose(rng, 2000)
    rank = digests.ranks(np.bincount(digests.entropy_classes(np.frombuffer((a + b).encode(), np.uint8)), minlength=CLASSES))
    like = lambda x, y: digests.likeness(*digests.digests([x, y], rank))
    assert like(a, a) == 1 and like("", "") == 1 and like("", a) == 0 and like("abc", "abc") == 1
    assert like(a, digests.edited(a, b)) > 0.4 > 0.15 > like(a, b) and like("abc", "abd") < 0.5
    short, other = prose(rng, 8), prose(rng, 8)
    assert like(short, digests.edited(short, other)) > 0.3 > like(short, other)


def test_edited_short_texts_stay_near_on_both_sides_of_every_bound():
    rng = random.Random(8)
    texts = [prose(rng, 1400)[: rng.choice([16, 20, 30, 60, 90, 200, 400, 760, 780, 1100, 1300])] for _ in range(1500)]
    # texts whose first two thirds are poor in rare windows
    texts += ["ab " * rng.randint(100, 400) + prose(rng, 300)[: rng.randint(0, 900)] for _ in range(200)]
    joined = "".join(texts).encode()
    rank = digests.ranks(np.bincount(digests.entropy_classes(np.frombuffer(joined, np.uint8)), minlength=CLASSES))
    changed = [digests.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    own, other = digests.digests(texts, rank), digests.digests(changed, rank)
    near = [digests.likeness(a, b) for a, b in zip(own, other)]
    far = [digests.likeness(a, b) for a, b in zip(own[:1499], own[1:1500])]
    assert min(near[:1500]) >= 0.3 and np.median(near) > 0.5 > 0.2 > np.median(far)
    held = [[bool(k) for k in digests._kinds(d)] for d in own + other]
    assert [True, False] in held and [False, True] in held and [True, True] in held
    assert all(a and b or c and d for (a, c), (b, d) in zip(held[: len(own)], held[len(own) :]))


def test_short_windows_in_order():
    raw = b"abcabcabcd"
    for size in (3, 8):
        want = list(dict.fromkeys(raw[i : i + size] for i in range(len(raw) - size + 1)))
        assert digests._windows(raw, size).tolist() == [int.from_bytes(w, "little") for w in want]
    assert len(digests._windows(b"ab", 3)) == 0


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_every_row_meets_the_next(spark, parts):
    rng = random.Random(7)
    texts = {i: prose(rng, rng.randint(0, 60)) for i in range(0, 90, 3)} | {1000: prose(rng, 30000), 1001: "é€😀" * 50, 1002: "", 1003: None}
    rows = [(i, t, "x", None) for i, t in texts.items()] + [(None, "no key", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in digests.compare_neighbours(df, parts).collect()}
    order = sorted(texts, reverse=True) + [None]
    texts[None] = "no key"
    rank = digests.rarity(df)
    assert len(got) == len(order)
    for d, following in zip(order, order[1:] + order[:1]):
        t, n = texts[d] or "", texts[following] or ""
        third = len(t) // 3
        changed = t[: len(t) - third] + n[:third]
        own, other, nxt = digests.digests([t, changed, n], rank)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (bytes(r.fingerprint), bytes(r.edited_fingerprint)) == (own, other)
        assert (r.near_edited, r.near_next) == (digests.likeness(own, other), digests.likeness(own, nxt))


def test_repeated_rows_single_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "a text", "", ""), (1, "a text", "", ""), (2, "a text", "", "")], SCHEMA)
    got = digests.compare_neighbours(same, 3).collect()
    assert len(got) == 3 and all(r.near_next == 1 and bytes(r.fingerprint) == bytes(got[0].fingerprint) for r in got)
    assert [r.near_next for r in digests.compare_neighbours(same.where("doc_id = 2"), 3).collect()] == [1]
    assert digests.compare_neighbours(same.where("false"), 3).collect() == []
