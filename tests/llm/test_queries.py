"""The registered queries over a whole given table: columns of their contracts, results against plain versions."""

import hashlib
import zlib

import pytest
from test_prefix_trie import brute as brute_trie
from test_quality import brute_counts
from test_resampling import brute as brute_draws
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from evalgrid.llm import sharding
from evalgrid.llm.catalog import QUERIES
from evalgrid.llm.tokens import default_tokenizer

BASE = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op4": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
            "sequence_id": "bigint", "offset": "bigint"},
    "op5": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6": {"doc_id": "bigint", "sample": "int", "n_tokens": "bigint", "inclusion": "double", "round_trip": "boolean"},
    "op7": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
            "near_edited": "double", "near_next": "double"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op11": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
             "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op13": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, query in QUERIES.items():
        df = query(spark, BASE)
        out[name.split("_")[0]] = (dict(df.dtypes), df.collect())
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}


def test_one_query_an_operator_with_its_columns(results, texts):
    assert results.keys() == CONTRACTS.keys()
    for name, (types, rows) in results.items():
        assert CONTRACTS[name].items() <= types.items(), name
        if name == "op12":
            continue
        assert {r.doc_id for r in rows} == texts.keys()
        if name not in ("op4", "op6"):
            assert len(rows) == len(texts)


def test_op1(results, texts):
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[d], 3) for d in ids]
    want = {d: (f"{f:016x}", ids[c]) for d, f, c in zip(ids, fps, brute_components(fps, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in results["op1"][1]} == want


def test_op2(results, texts):
    for r in results["op2"][1]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])


def test_op4_and_op10(results, texts):
    plain = Tokenizer.from_file(default_tokenizer())
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    start = 0
    for r in sorted(results["op10"][1], key=lambda r: r.doc_id):
        want = ids[r.doc_id] + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), crc(want))
        start += len(want)
    ends, filled = {}, {}
    for r in sorted(results["op4"][1], key=lambda r: (r.doc_id, r.start)):
        want = ids[r.doc_id] + [1]
        assert r.start == ends.get(r.doc_id, 0) and r.doc_tokens == len(want)
        assert r.ids_crc32 == crc(want[r.start : r.start + r.length])
        ends[r.doc_id] = r.start + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ends == {d: len(x) + 1 for d, x in ids.items()}
    for pieces in filled.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 2048 and total & (total - 1) == 0


def test_op5(results, texts):
    rows = results["op5"][1]
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert (r.shard, r.slot) == sharding.locate(r.row_number, len(rows), 24)


def test_op6(results, texts):
    seen = {}
    for r in results["op6"][1]:
        assert r.round_trip and 0 <= r.inclusion <= 1 and r.log_inclusion <= 0
        seen.setdefault(r.doc_id, []).append(r.ids_crc32)
    assert all(len(set(v)) == 2 for d, v in seen.items() if texts[d])


def test_op7(results, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in results["op7"][1]}
    near = []
    for d, following in zip(order, order[1:] + order[:1]):
        t, n = texts[d] or "", texts[following] or ""
        third = len(t) // 3
        assert rows[d].edited_sha256 == hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()
        near.append(rows[d].near_edited > rows[d].near_next or t == n)
    assert sum(near) > 0.9 * len(near)
    same = {}
    for d, t in texts.items():
        same.setdefault(t, set()).add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_op8_and_op9(results):
    for name, threshold in (("op8", 0.3), ("op9", 0.5)):
        for r in results[name][1]:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)


def test_op11(results, texts, spark):
    target = [r.text for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in results["op11"][1]]
    assert sorted(got, key=repr) == sorted(brute_draws(list(texts.items()), target), key=repr)


def test_op12(results, spark):
    turns = spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted((tuple(r) for r in results["op12"][1]), key=repr) == brute_trie([tuple(r) for r in turns])


def test_op13(results, texts):
    for r in results["op13"][1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
