import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from evalgrid.llm import packing, token_files
from evalgrid.llm.tokens import Encoder, default_tokenizer

TEXTS = [
    None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n a", "x\x1c y", "don't  'll it's", "a   ", "\t x", "日本 語 x٣4 ½ ²",
    "a　 b    c", "1 2  3", "ñandú über ß ªº Ǆ", "it.\nAtes it's\n\nx 12ab.c d\n", "<|endoftext|> a<|endoftext|>", "word " * 5000, "x" * 20000,
]
SCHEMA = "doc_id long, text string, ids string, part string, sequence_id string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _rows():
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return rows + [(None, "no key", None, None, None), (3, "again", "a", "b", "c"), (3, "again", "a", "b", "c")]


def test_encoder_matches_the_library(plain):
    for keep in (4, 1000):
        enc = Encoder(default_tokenizer(), keep=keep)
        for _ in range(2):
            assert [x.tolist() for x in enc.encode(TEXTS)] == [plain(t) for t in TEXTS]


def test_added_tokens_match_the_library_by_default():
    library, enc = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer(), added=True)
    end = "<|endoftext|>"
    more = [end, end * 3, f" {end} ", f"a {end}b  {end}\n c", f"it{end}'s  <|endoftext |> <|{end}", f"x{end[:-1]}", f"\n\n{end}\n\nword"]
    assert [x.tolist() for x in enc.encode(TEXTS + more)] == [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS + more]
    assert enc.encode([f"a{end}"])[0].tolist()[-1] == 50256


def test_values_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 1001):
        v = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") >> rng.integers(0, 32, n).astype("<u4")
        control, data = token_files.encode_values(v)
        back = token_files.decode_values(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), n)
        assert (back == v).all()


@pytest.mark.parametrize("block_ids", [50, 1_000_000])
def test_token_files_round_trip(spark, tmp_path, plain, block_ids):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, default_tokenizer(), block_ids=block_ids)
    got = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    start, want = 0, {}
    for key, text, *_ in _rows():
        want.setdefault(key, []).append(plain(text) + [0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(r.ids))
        start += len(ids)
    assert not any(want.values())


def test_words_are_encoded_once_within_the_bound(monkeypatch):
    texts = [" ".join(f"w{i * 31 % 997}q{i % 7}" for i in range(n, n + 400)) for n in range(0, 4000, 400)]
    enc, seen = Encoder(default_tokenizer()), []
    word = enc._word
    monkeypatch.setattr(enc, "_word", lambda w: seen.append(w) or word(w))
    first = enc.encode(texts)
    assert len(seen) == len(set(seen)) > 500
    before = len(seen)
    assert all((x == y).all() for x, y in zip(first, enc.encode(texts))) and len(seen) == before
    # a bound that holds a few words: the same ids
    tight = Encoder(default_tokenizer(), keep=20_000)
    assert all((x == y).all() for x, y in zip(first, tight.encode(texts)))
    assert len(tight._new) + len(tight._old) < 120


def test_new_words_are_merged_together(plain):
    class Counting:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, chars):
            self.calls += 1
            return self.model.tokenize(chars)

    words = ["".join("abdeilnorstéü"[i * k % 13] for k in range(1, 3 + i % 9)) + "," * (i % 5 == 0) for i in range(400)]
    enc = Encoder(default_tokenizer())
    enc._model = Counting(enc._model)
    assert enc.encode([" ".join(words)])[0].tolist() == plain(" ".join(words))
    assert enc._model.calls < 20


def test_white_space_before_spaces_matches_the_library(plain):
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", " \n", "a", "Bé", ".", "'s", "\t", "\u3000", "\xa0", "\r", "\x1c", "\x85", "1", "日", "ab ", "a\n"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n % 9)) for n in range(3000)]
    for keep in (500, 1 << 20):  # words that end texts may not be taken for words before a space
        assert [x.tolist() for x in Encoder(default_tokenizer(), keep=keep).encode(texts)] == [plain(t) for t in texts]


def test_ids_are_ranked_without_sorting_them(monkeypatch):
    rng = np.random.default_rng(6)
    ids = (rng.integers(0, 300, 5000) ** 2 // 9).astype("<u4")
    distinct, count = np.unique(ids, return_counts=True)
    want = distinct[np.lexsort((distinct, -count))]
    high = token_files.rank_ids(np.append(ids, [1 << 31]).astype("<u4"))
    assert (high[0][high[1]] == np.append(ids, [1 << 31])).all()
    monkeypatch.setattr(token_files.np, "unique", None)
    by_frequency, ranks = token_files.rank_ids(ids)
    assert (by_frequency == want).all() and (by_frequency[ranks] == ids).all()
    keys, sizes, back = token_files.decode_block(token_files.encode_block([3, None], [ids[:70], ids[70:]]))
    assert keys == [3, None] and sizes.tolist() == [70, 4930] and (back == ids).all()


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path, default_tokenizer())
    assert token_files.read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("group_tokens", [300, 2_000_000])
def test_packing_covers_every_id_once(spark, plain, group_tokens):
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(2)
    tiers = (16, 64, 256)
    got = packing.pack_documents(df, default_tokenizer(), tiers=tiers, group_tokens=group_tokens, step_tokens=1024, with_ids=True).collect()
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_length <= 256 and at & (at - 1) == 0
    want = {}
    for key, text, *_ in _rows():
        want.setdefault(key, []).append(plain(text) + [1])
    for key, rows in docs.items():
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start)]).tolist()
        if len(want[key]) == 1:
            assert ids == want[key][0] and {r.doc_tokens for r in rows} == {len(ids)}
        else:
            assert sorted(ids) == sorted(x for w in want[key] for x in w)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), default_tokenizer()).collect() == []
