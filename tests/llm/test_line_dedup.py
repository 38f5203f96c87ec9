import random

import pytest

from evalgrid.llm import line_dedup
from evalgrid.llm.catalog import _op3_sql

SCHEMA = "doc_id long, text string, n_lines string, lost string, digest string"
LONG = "A line that many documents share"


def brute(rows, least, min_docs):
    """[(doc_id, text, n_lines, n_dropped)] of [(doc_id, text)], by a plain reading of the rule."""
    space = " \t\n\x0b\x0c\r"

    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
        return k if len(k) >= least else None

    holders = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or key(x) is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def documents():
    rng = random.Random(4)
    pool = [f"sentence number {i} of a common pool" for i in range(30)] + ["short", "", "   ", "É" * 20, "é" * 19 + "\x1c"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t", "\x0b"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100 + i, f"{LONG}\nown text of document {i}\n  {LONG.upper()}\r\n{LONG}") for i in range(40)]
    rows += [(None, LONG), (None, None), (300, None), (301, ""), (302, "\n\n"), (5, f"{LONG} again"), (5, f"{LONG} again"), (6, f"{LONG} again")]
    return rows + [(400, "\n".join(f"{LONG} {i}" for i in range(5000))), (401, f"{LONG} 1\n{LONG} 2"), (402, f"{LONG} 2\n{'x' * 100000}")]


@pytest.mark.parametrize("least,min_docs,most_bytes", [(20, 3, 1 << 20), (1, 2, 1 << 20), (20, 3, 64)])
def test_matches_brute_force(spark, least, min_docs, most_bytes):
    rows = documents()
    df = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(4)
    got = line_dedup.dedup_lines(df, least, min_docs, most_bytes).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in got], key=order) == sorted(brute(rows, least, min_docs), key=order)


@pytest.mark.parametrize("hashes_a_part", [20, 1 << 20])
def test_filter_follows_the_repeats_in_any_number_of_parts(spark, hashes_a_part):
    import xxhash

    # 12,000 lines of one document each, 300 of two, one of all
    rows = [(i, "\n".join([f"{LONG} {i} {j}" for j in range(20)] + [f"{LONG} shared by two {i // 2}", LONG])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    repeats = line_dedup._repeats(line_dedup._hash_lists(df, 20), hashes_a_part).collect()
    hashes = [h for r in repeats for h in line_dedup.np.frombuffer(r.hashes, line_dedup.np.uint64).tolist()]
    assert len(set(hashes)) == len(hashes) and 301 <= len(hashes) < 301 + 12_000 * 0.05
    assert all(int(h) >> 58 == r.part for r in repeats for h in line_dedup.np.frombuffer(r.hashes, line_dedup.np.uint64))
    want = [xxhash.xxh3_64_intdigest(f"{LONG} shared by two {i}".lower()) for i in range(300)] + [xxhash.xxh3_64_intdigest(LONG.lower())]
    assert set(want) <= set(hashes)
    bits = line_dedup.twice_seen(df, 20, hashes_a_part=hashes_a_part)
    filters = [line_dedup.Bloom(0, b) if b else None for b in bits]
    suspects = line_dedup._suspects([t for _, t in rows], 20, filters)
    assert all(len(s) >= 2 for s in suspects) and sum(map(len, suspects)) < 1200 + 12_000 * 0.06
    assert sum(map(len, bits)) <= 64 * 64  # sized by the repeats, not by all lines


def test_a_list_names_a_hash_twice_at_most(spark):
    df = spark.createDataFrame([(i, LONG) for i in range(500)], "doc_id long, text string").coalesce(1)
    assert sum(len(r.hashes) for r in line_dedup._hash_lists(df, 20).collect()) == 16


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_filter_has_no_false_negatives():
    import numpy as np

    f, h = line_dedup.Bloom(64), np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    f.add(h[:250])
    assert f.has(h[:250]).all()


def test_sql_matches_on_the_given_table(spark):
    import duckdb

    from evalgrid.llm.catalog import QUERIES

    base = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{base}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({_op3_sql()})").fetchall())
    got = QUERIES["op3_bloom_line_dedup"](spark, base).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want and sum(r[2] for r in want) > 0
