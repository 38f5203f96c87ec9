from collections import Counter
from math import exp, expm1, log

import numpy as np
import pytest
import sentencepiece

from evalgrid.llm import sampling
from evalgrid.llm.sampling import SPACE, Vocabulary, default_model, sample

SCHEMA = "doc_id long, text string, sample string, ids string"
TEXTS = ["", "a", " ", "   ", "hello world", "a\nb\n\n c", "日本 x é€😀", f"{SPACE}x", "x" * 300, " lead and  trail ", "\x00 nul", "the end. " * 3000]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def brute(v, library, text):
    """{ids: probability} of all segmentations."""
    pieces = {library.id_to_piece(i): i for i in range(259, v.size)}
    s = SPACE + text.replace(" ", SPACE)

    def ways(at):
        if at == len(s):
            yield (), 0.0
            return
        steps = [(1, v.byte_ids[list(s[at].encode())].tolist(), v.unknown_logp * len(s[at].encode()))] if s[at] not in pieces else []
        steps += [(n, [pieces[s[at : at + n]]], v.logp[pieces[s[at : at + n]]]) for n in range(1, 17) if len(s[at : at + n]) == n and s[at : at + n] in pieces]
        for n, ids, w in steps:
            for rest, total in ways(at + n):
                yield (*ids, *rest), w + total

    found = dict(ways(0))
    total = sum(map(exp, found.values()))
    return {ids: exp(w) / total for ids, w in found.items()}


@pytest.mark.parametrize("text", ["hello", "a b", "x\ny", "日é", "to the"])
def test_probabilities_match_brute_force(vocabulary, library, text):
    want = brute(vocabulary, library, text)
    k = min(len(want) + 2, 40)
    drawn = sample(vocabulary, [text], [7], k)[0]
    assert len(drawn) == min(k, len(want)) and len({tuple(ids.tolist()) for ids, *_ in drawn}) == len(drawn)
    values = [value for _, _, value, _ in drawn]
    assert values == sorted(values, reverse=True)
    for ids, phi, _, log_q in drawn:
        assert phi == pytest.approx(log(want[tuple(ids.tolist())]), abs=1e-4) and log_q <= 0


def test_draws_are_without_replacement_in_proportion(vocabulary, library):
    text, n = "hel", 6000
    flat = Vocabulary(default_model(), alpha=0.2)
    want = brute(flat, library, text)
    drawn = sample(flat, [text] * n, list(range(n)), 2)
    first = Counter(tuple(d[0][0].tolist()) for d in drawn)
    for ids, p in want.items():
        assert first[ids] / n == pytest.approx(p, abs=0.025)
    top = max(want, key=want.get)
    second = Counter(tuple(d[1][0].tolist()) for d in drawn if tuple(d[0][0].tolist()) == top)
    for ids, p in want.items():
        if ids != top:
            assert second[ids] / first[top] == pytest.approx(p / (1 - want[top]), abs=0.04)
    # the mean of 1 / inclusion over the draws estimates the number of segmentations
    total = np.mean([sum(exp(phi - log_q) for _, phi, _, log_q in d) for d in drawn])
    assert total == pytest.approx(1, abs=0.05)


def test_inclusion_uses_the_next_value(vocabulary):
    a, b = sample(vocabulary, ["hello world"], [3], 2)[0], sample(vocabulary, ["hello world"], [3], 3)[0]
    assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b[:2]]
    for _, phi, _, log_q in a:
        assert exp(log_q) == pytest.approx(-expm1(-exp(phi - b[2][2])), abs=1e-6)
    long = sample(vocabulary, ["the end. " * 3000], [3], 2)[0]
    assert all(log_q == pytest.approx(min(0, log_q)) and log_q < -745 for *_, log_q in long)


def test_decoding_matches_the_library(vocabulary, library):
    together = sample(vocabulary, TEXTS, list(range(len(TEXTS))), 3)
    for key, (text, drawn) in enumerate(zip(TEXTS, together)):
        alone = sample(vocabulary, [text], [key], 3)[0]
        assert [x[0].tolist() for x in alone] == [x[0].tolist() for x in drawn]  # batches change nothing
        for ids, *_ in drawn:
            assert vocabulary.decode(ids) == library.decode(ids.tolist()) == text.replace(SPACE, " ")


def test_documents(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(None, None, "", ""), (None, "no key", "", ""), (4, TEXTS[4], "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sampling.sample_segmentations(df, default_model(), k=2, with_ids=True).collect()
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in got)
    twice = [r for r in got if r.doc_id == 4]
    assert len(twice) == 4 and len({bytes(r.ids) for r in twice}) == 2
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sampling.sample_segmentations(df.where("false"), default_model()).collect() == []


def test_noise_is_drawn_for_all_texts_of_a_batch_at_once(vocabulary, monkeypatch):
    texts = [f"{'日 é' * (i % 3)} {'the end of it.' * (i % 2)}\n{'the end of it. ' * (i % 40)}{i}" for i in range(300)]
    calls, uniforms = [], sampling.uniforms
    monkeypatch.setattr(sampling, "uniforms", lambda *a: calls.append(1) or uniforms(*a))
    drawn = sample(vocabulary, texts, list(range(len(texts))), 3)
    assert all(vocabulary.decode(ids) == t.replace(SPACE, " ") for t, d in zip(texts, drawn) for ids, *_ in d)
    assert len(calls) < len(texts)  # some for each draw and step, none for each text


def test_sums_of_few_and_of_many_strings_agree(vocabulary):
    strings = [f" w{i}hello{'x' * (i % 30)}" for i in range(200)]
    together = sampling.Lattice(vocabulary, strings)
    for i in (0, 29, 199):
        alone = sampling.Lattice(vocabulary, [strings[i]])
        a, b = together.start[i], together.end[i]
        assert (together.code[a:b, : alone.width] == alone.code[:-1]).all() and (together.code[a:b, alone.width :] < 0).all()
        assert np.allclose(np.exp(together.sum[a:b, alone.width - 1].astype(float)), np.exp(1), atol=1e-5)
        assert np.allclose(together.logp[a:b, : alone.width], alone.logp[:-1], atol=1e-6)
