"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

from evalgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x string"


def brute(rows, family=5, heads=9):
    spoken = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            spoken[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in spoken.items()}
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + said[h:]
    nodes = defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            nodes[tuple(said[:d])].append(c)
    children, leaves, saved = Counter(n[:-1] for n in nodes if n), Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(n))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=repr)


def odd_rows(n, seed):
    rnd = random.Random(seed)
    convs = [None, -7, -5, 0, 1, 2, 3, 5, 6, 10, 11, 12, 13, 14, 40, 41]
    return [(rnd.choice(convs), rnd.choice([None, 1, 2, 3]), rnd.choice([None, "u", "a"]), rnd.choice([None, "", "x", "yé"])) for _ in range(n)]


def test_nulls_ties_repeats_and_shared_beginnings(spark):
    rows = odd_rows(150, 1) + [(100 + i % 10, i // 10, "u", f"t{i // 10 % 3}") for i in range(200)]
    assert trie(spark, rows) == brute(rows)


def test_many_bands_and_stretches(spark, monkeypatch):
    # one conversation of 60 turns and its copies, over bands of 2 and stretches of 7
    monkeypatch.setattr(prefix_trie, "BAND", 2)
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = [(c, t, "u", f"{t}" if t < 40 else f"{t} {c % 2}") for c in (0, 1, 2, 3, 20) for t in range(61 - c)]
    assert trie(spark, rows) == brute(rows)


def test_many_members_that_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 4)
    rows = [(c, 0, "u", "x" * 3000) for c in range(0, 300, 3)] + [(c, 1, "a", "long " * 200_000) for c in (3, 6)]
    assert trie(spark, rows) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    conv = next(c for c in range(1, 100) if c % 5 and h(c) > 1)  # its base is absent and it has one turn
    (root,) = trie(spark, [(conv, 1, "u", "x")])
    assert root == (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())


def test_empty_table(spark):
    assert trie(spark, []) == trie(spark, [(None, 1, "u", "x")]) == []
