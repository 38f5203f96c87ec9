"""Sampled SentencePiece segmentations without replacement, and decoding.

The pieces of a vocabulary span a lattice over a text: a node for each place,
an edge for each piece. Pieces carry unigram log-probabilities (Zipf's law
over their ranks), sums over the lattice from the right normalise them, and so
every step from a node has its probability given all that may follow.

Gumbel top-k draws k distinct segmentations without replacement: the
segmentations with the k largest sums of log-probability and Gumbel noise. A
node of the search tree carries the largest such sum below it, so best-first
(A*) search with this exact bound needs no enumeration. The noise is drawn top
down: the step taken keeps the bound, all steps not taken share one bound,
drawn as a Gumbel below the first and split only when the search reaches it.

Texts are cut where no piece crosses (before spaces, around words), equal cuts
share their part of the lattice, and numpy works on all texts of a batch. The
noise depends on the row's key, the place and the draw, not on the batch.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalgrid.llm.common import kept_in_worker

SPACE = "▁"
#: Characters of texts that are worked on at once (a longer text is a batch of its own).
_CHARS = 1_600_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_CUT = re.compile(f"\\n|[ {SPACE}]*[^ {SPACE}\\n]+|[ {SPACE}]+")
#: Where no piece holds both Latin letters and other characters, texts are also cut between them.
_FINE_CUT = re.compile(f"\\n|[ {SPACE}]*[{_LETTER}]+|[ {SPACE}]*[^{_LETTER} {SPACE}\\n]+|[ {SPACE}]+")
_MIXED = re.compile(f"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{SPACE}][{_LETTER}]")


def default_model() -> str:
    """Path of the public SentencePiece model (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(keys: list[int]) -> np.ndarray:
    """A seed for each row key."""
    with np.errstate(over="ignore"):
        return _mix(_mix(np.array(keys, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def uniforms(seed: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a row's seed, the place in its text and the stream."""
    with np.errstate(over="ignore"):
        x = place.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = _mix(x + (seed + np.uint64(stream) * np.uint64(0x8CB92BA72F3D8DD7 | 1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces as a trie in an open hash table, their log-probabilities and bytes."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        usable = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any("\n" in pieces[i] or SPACE in pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("no piece may hold a line end, or a space after other characters")
        self.cut = _CUT if any(_MIXED.search(pieces[i]) for i in usable) else _FINE_CUT
        self.byte_ids = np.zeros(256, "<u4")
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        # Zipf's law over ranks; pieces that the model all but forbids come last
        ranked = sorted(usable, key=lambda i: (-sp.get_score(i), i))
        weight = 1 / np.arange(2, len(ranked) + 2)
        weight = alpha * (np.log(weight) - np.log(weight.sum()))
        self.logp = np.full(self.size, weight[-1])
        self.logp[ranked] = weight
        self.logp_or_none = np.append(self.logp, -np.inf)
        self.unknown_logp = float(weight[-1])
        self.bytes = [pieces[i].replace(SPACE, " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self._spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._spelt_len = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self._spelt_at = np.cumsum(self._spelt_len) - self._spelt_len
        self.longest = max(len(pieces[i]) for i in usable)
        # trie: children by (node, code point)
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in usable:
            node = 0
            for c in map(ord, pieces[i]):
                nxt = children.get((node, c))
                if nxt is None:
                    nxt = children[node, c] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        self.end = np.array(ends, np.int32)
        self._bits = max(4, (4 * len(children)).bit_length())
        keys = np.array([n << 21 | c for n, c in children], np.int64)
        kids = np.array(list(children.values()), np.int32)
        self._keys, self._kids = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self._probes = 0
        while len(left):
            self._probes += 1
            free = left[self._keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self._keys[slot[won]], self._kids[slot[won]] = keys[won], kids[won]
            left = np.setdiff1d(left, won)
            slot[left] = slot[left] + 1 & (1 << self._bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def children(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Child nodes by character, -1 where there is none."""
        keys = node.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        held = self._keys.take(slot)
        hit = held == keys
        out = np.where(hit, self._kids.take(slot), np.int32(-1))
        left = np.flatnonzero(~hit & (held >= 0))
        slot = slot[left]
        for _ in range(self._probes):
            if not len(left):
                break
            slot = slot + 1 & (1 << self._bits) - 1
            held = self._keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self._kids[slot[hit]]
            more = ~hit & (held >= 0)
            left, slot = left[more], slot[more]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids were made of (without the space put before it)."""
        size = self._spelt_len.take(ids)
        ends = np.cumsum(size)
        at = np.repeat(self._spelt_at.take(ids) - ends + size, size)
        return self._spelling.take(at + np.arange(len(at))).tobytes().decode("utf-8", "replace")[1:]


class Lattice:
    """Lattices of distinct strings, one after the other; columns are piece lengths.

    ``code``: piece id, or vocabulary size plus code point for a character
    spelt in bytes, -1 for no edge. ``logp``: of the step given its node.
    """

    def __init__(self, vocabulary: Vocabulary, strings: list[str]):
        v, self.vocabulary = vocabulary, vocabulary
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(lens + 1) - lens - 1
        self.end = self.start + lens
        chars = np.frombuffer("\x00".join([*strings, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        chars[chars == 32] = ord(SPACE)
        n, inside = len(chars), np.ones(len(chars), bool)
        inside[self.end] = False
        at = np.flatnonzero(inside)
        node, found = np.zeros(len(at), np.int32), []
        self.last = np.zeros(n, np.int64)
        for k in range(v.longest):
            if k:
                ok = inside[np.minimum(at + k, n - 1)] & (at + k < n)
                at, node = at[ok], node[ok]
            node = v.children(node, chars[at + k])
            more = node >= 0
            at, node = at[more], node[more]
            if not len(at):
                break
            ids = v.end[node]
            some = ids >= 0
            found.append((at[some], ids[some], v.logp[ids[some]]))
            self.last[at[some]] = k
        while len(found) > 1 and not len(found[-1][0]):
            found.pop()
        found = found or [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        self.width = width = len(found)
        # characters without a piece of their own are steps of one character too
        known = ~inside
        known[found[0][0]] = True
        spelt = np.flatnonzero(~known)
        found[0] = tuple(
            np.concatenate(both)
            for both in zip(found[0], (spelt, (v.size + chars[spelt]).astype(np.int32), v.unknown_logp * _byte_length(chars[spelt])))
        )
        self.code = np.full((n, width), -1, np.int32)
        for k, (at, ids, _) in enumerate(found):
            self.code.reshape(-1)[at * width + k] = ids
        total = self._sums(lens, n, [(at, w) for at, _, w in found])
        self.logp = np.full((n, width), -np.inf, np.float32)
        self.sum = np.zeros((n, width), np.float32)
        for k, (at, _, w) in enumerate(found):
            step = (w + (total[at + k + 1] - total[at])).astype(np.float32)
            self.logp.reshape(-1)[at * width + k] = step
            self.sum.reshape(-1)[at * width + k] = np.exp(step)
        np.cumsum(self.sum, axis=1, out=self.sum)

    def _sums(self, lens: np.ndarray, n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log of the summed weights from each place to its string's end; ``edges``: (places, weights) by length."""
        # places are put in order of their distance from the end, within it longer strings first:
        # so those at one distance stand together, and what follows them begins what stands at a smaller one
        by_length = np.argsort(-lens, kind="stable")
        most = int(lens.max(initial=0))
        many = np.searchsorted(-lens[by_length], -np.arange(most + 1), side="right")
        first = np.cumsum(many) - many
        rank = np.empty(len(lens), np.int64)
        rank[by_length] = np.arange(len(lens))
        ahead = np.repeat(self.end, lens + 1) - np.arange(n)
        slot = first[ahead] + np.repeat(rank, lens + 1)
        width = len(edges)
        weight = np.full((width, n), -np.inf)
        for k, (at, w) in enumerate(edges):
            weight[k, slot[at]] = w
        total = np.zeros(n)
        for d in range(1, most + 1):
            a, m, k = first[d], many[d], min(d, width)
            if m > 64:
                value = [weight[i, a : a + m] + total[first[d - 1 - i] : first[d - 1 - i] + m] for i in range(k)]
                top = value[0]
                for x in value[1:]:
                    top = np.maximum(top, x)
                each = np.exp(value[0] - top)
                for x in value[1:]:
                    each += np.exp(x - top)
            else:
                value = weight[:k, a : a + m] + total[first[d - 1 - np.arange(k)][:, None] + np.arange(m)]
                top = value.max(axis=0)
                each = np.exp(value - top).sum(axis=0)
            total[a : a + m] = top + np.log(each)
        return total[slot]

    def logp_of(self, node: np.ndarray, step: np.ndarray) -> np.ndarray:
        return self.logp.reshape(-1).take(node * self.width + step).astype(np.float64)


def _byte_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _below(location: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel noise at ``location`` given that it is at most ``bound``."""
    with np.errstate(over="ignore"):
        return np.minimum(location - np.log(np.exp(location - bound) - np.log(u)), bound)


class _Path:
    """A segmentation: steps in order, its log-probability and perturbed value; bounds of what it passed by."""

    __slots__ = ("place", "node", "step", "logp", "value", "first", "excluded")

    def __init__(self, place, node, step, logp, value, first=0, excluded=()):
        self.place, self.node, self.step, self.logp = place, node, step, logp
        self.value, self.first, self.excluded = value, first, excluded  # steps before ``first`` are another path's


#: Steps that are looked at first, and what no noise exceeds.
_AHEAD, _MOST_NOISE = 96, 37.5


def _bounds(lattice: Lattice, parts: list[tuple[_Path, np.ndarray, int, int]], seed: np.ndarray, draw: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (path, sums before its steps, from, to) the steps from ``from`` to ``to`` that had alternatives, and their bounds."""
    sizes = np.array([b - a for _, _, a, b in parts], np.int64)
    start = np.cumsum(sizes) - sizes
    logp, place, node, step, before = (
        np.concatenate([x[a:b] for x, a, b in xs])
        for xs in zip(*(((p.logp, a, b), (p.place, a, b), (p.node, a, b), (p.step, a, b), (before, a, b)) for p, before, a, b in parts))
    )
    rest = -np.expm1(logp)
    small = rest < 0.01  # here a difference from 1 would lose digits
    excluding = [i for i, (p, _, a, b) in enumerate(parts) if p.excluded and a == p.first < b]
    small[start[excluding]] = True
    small = np.flatnonzero(small)
    others = np.exp(lattice.logp.take(node[small], axis=0))
    others[np.arange(len(small)), step[small]] = 0
    for i, row in zip(excluding, np.searchsorted(small, start[excluding])):
        others[row, list(parts[i][0].excluded)] = 0
    rest[small] = others.sum(axis=1, dtype=np.float64)
    left = np.flatnonzero(rest)
    cut = np.searchsorted(left, np.append(start, len(rest)))
    many = np.diff(cut)
    u = uniforms(np.repeat(seed, many), place[left], 2 * draw + 1)
    value = np.repeat(np.array([p.value for p, *_ in parts]), many)
    bound = _below(before[left] + np.log(rest[left]), value, u)
    left += np.repeat(np.array([a for _, _, a, _ in parts], np.int64) - start, many)
    return [(left[i:j], bound[i:j]) for i, j in zip(cut, cut[1:])]


def _open(lattice: Lattice, opened: list[tuple[int, int, _Path]], seed: np.ndarray, draw: int, queues: list[list], k: int) -> None:
    """Put the k best bounds of steps that each path has not taken into its text's queue; ``opened``: (text, path's number, path)."""
    if not opened:
        return
    before = [np.cumsum(path.logp) - path.logp for _, _, path in opened]  # falls from step to step
    own = seed[[d for d, _, _ in opened]]
    parts = [(path, b, path.first, min(path.first + _AHEAD, len(b))) for (_, _, path), b in zip(opened, before)]
    found = _bounds(lattice, parts, own, draw)
    more, further = [], []
    for i, ((path, b, _, stop), (_, bound)) in enumerate(zip(parts, found)):
        upto = len(b)
        # noise from 53-bit numbers is below MOST_NOISE, so steps that lie as far below the k-th bound cannot matter
        if stop < upto and len(bound) >= k:
            upto = int(np.searchsorted(-b, _MOST_NOISE - (bound.max() if k == 1 else np.partition(bound, -k)[-k])))
        if upto > stop:
            more.append(i)
            further.append((path, b, stop, upto))
    if more:
        for i, (left, bound) in zip(more, _bounds(lattice, further, own[more], draw)):
            found[i] = np.concatenate([found[i][0], left]), np.concatenate([found[i][1], bound])
    for (d, number, path), (left, bound) in zip(opened, found):
        best = np.argpartition(-bound, k - 1)[:k] if len(bound) > k else np.arange(len(bound))
        for b in best.tolist():
            i = int(left[b])
            excluded = (*path.excluded, int(path.step[i])) if i == path.first else (int(path.step[i]),)
            heapq.heappush(queues[d], (-float(bound[b]), number, i, excluded))


def sample(vocabulary: Vocabulary, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text up to k segmentations: (ids, log-probability, perturbed value, log inclusion score), best value first.

    The inclusion score is the probability that the segmentation exceeds the
    (k + 1)th value: 1 if there are no more than k. Long texts need its log.
    """
    cuts, owner = [], []
    for t in texts:
        own = vocabulary.cut.findall(" " + t) if t else []
        cuts += own
        owner.append(len(own))
    number = defaultdict(count().__next__)
    cut, many = np.fromiter(map(number.__getitem__, cuts), np.int64, len(cuts)), np.array(owner, np.int64)
    lattice = Lattice(vocabulary, list(number) or ["x"])
    doc = np.repeat(np.arange(len(texts)), many)
    lens = lattice.end[cut] - lattice.start[cut]
    first_cut = np.cumsum(many) - many
    place = np.cumsum(lens) - lens
    place -= np.repeat(place[np.minimum(first_cut, max(len(place) - 1, 0))], many) if len(place) else 0
    seed = seeds(keys)

    def walks(jobs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], draw: int) -> list[tuple[np.ndarray, ...]]:
        """Steps (place, node, step, log-probability) of (text, nodes, stops, places) for each job, all walked at once."""
        sizes = np.array([len(j[1]) for j in jobs], np.int64)
        which = np.repeat(np.arange(len(jobs)), sizes)
        if not len(which):
            return [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),) for _ in jobs]
        nodes, stops, places = (np.concatenate([j[i] for j in jobs]) for i in (1, 2, 3))
        shift = np.cumsum([int(j[3][-1] + j[2][-1] - j[1][-1]) + 1 if len(j[3]) else 1 for j in jobs])
        shift = np.concatenate([[0], shift[:-1]])
        # places are made distinct between jobs for the order, the noise uses those in the text
        got = lattice_walk(nodes, stops, places, seed[[j[0] for j in jobs]][which], shift[which], draw)
        at = np.searchsorted(got[0], np.append(shift, np.iinfo(np.int64).max))
        logp = lattice.logp_of(got[1], got[2])
        return [(got[0][a:b] - s, got[1][a:b], got[2][a:b], logp[a:b]) for a, b, s in zip(at, at[1:], shift)]

    ones = np.ones(lattice.width, np.uint8)

    def lattice_walk(node, stop, at, row_seed, shift, draw):
        out = []
        while True:
            on = node < stop
            node, stop, at, row_seed, shift = node[on], stop[on], at[on], row_seed[on], shift[on]
            if not len(node):
                break
            u = uniforms(row_seed, at, 2 * draw).astype(np.float32)
            step = np.minimum((u[:, None] >= lattice.sum.take(node, axis=0)).view(np.uint8) @ ones, lattice.last.take(node))
            out.append((at + shift, node, step))
            node, at = node + step + 1, at + step + 1
        places, nodes, steps = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(places, kind="stable")
        return places[order], nodes[order], steps[order]

    spans = [slice(a, a + n) for a, n in zip(first_cut, many)]
    starts, stops = lattice.start[cut], lattice.end[cut]
    root = -np.log(-np.log(uniforms(seed, np.full(len(seed), -1), 0)))
    paths: list[list[_Path]] = []
    queues: list[list] = []
    for d, (at, node, step, logp) in enumerate(walks([(d, starts[s], stops[s], place[s]) for d, s in enumerate(spans)], 0)):
        paths.append([_Path(at, node, step, logp, float(root[d]))])
        queues.append([])
    _open(lattice, [(d, 0, paths[d][0]) for d in range(len(texts))], seed, 0, queues, k)
    for draw in range(1, k):
        popped = [(d, *heapq.heappop(queues[d])) for d in range(len(texts)) if queues[d]]
        if not popped:
            break
        nodes = np.array([paths[d][number].node[i] for d, _, number, i, _ in popped])
        ats = np.array([paths[d][number].place[i] for d, _, number, i, _ in popped])
        p = np.exp(lattice.logp[nodes], dtype=np.float64)
        for row, (*_, excluded) in zip(p, popped):
            row[list(excluded)] = 0
        c = np.cumsum(p, axis=1)
        u = uniforms(seed[[d for d, *_ in popped]], ats, 2 * k + draw) * c[:, -1]
        last = lattice.width - 1 - (p[:, ::-1] > 0).argmax(axis=1)
        taken = np.minimum((c <= u[:, None]).sum(axis=1), last)
        jobs = []
        for (d, *_), node, at, step in zip(popped, nodes.tolist(), ats.tolist(), taken.tolist()):
            nxt, s = at + step + 1, spans[d]
            here = s.start + int(np.searchsorted(place[s], at, side="right")) - 1
            after = slice(here + 1, s.stop)
            jobs.append((
                d, np.append(node + step + 1, starts[after]), np.append(stops[here], stops[after]), np.append(nxt, place[after])
            ))
        made, opened = lattice.logp_of(nodes, taken), []
        for j, ((d, bound, number_, i, excluded), (p2, n2, s2, l2)) in enumerate(zip(popped, walks(jobs, draw))):
            parent, one = paths[d][number_], slice(j, j + 1)
            places, node = np.concatenate([parent.place[:i], ats[one], p2]), np.concatenate([parent.node[:i], nodes[one], n2])
            steps, logp = np.concatenate([parent.step[:i], taken[one], s2]), np.concatenate([parent.logp[:i], made[one], l2])
            paths[d].append(_Path(places, node, steps, logp, -bound, i, excluded))
            opened.append((d, len(paths[d]) - 1, paths[d][-1]))
        _open(lattice, opened, seed, draw, queues, k - draw)
    out = []
    for d in range(len(texts)):
        limit = -queues[d][0][0] if queues[d] and len(paths[d]) == k else -np.inf
        rows = []
        for path in paths[d]:
            phi = float(path.logp.sum())
            rows.append((_ids(vocabulary, lattice.code.reshape(-1).take(path.node * lattice.width + path.step)), phi, path.value, _log_inclusion(phi - limit)))
        out.append(rows)
    return out


def _log_inclusion(above: float) -> float:
    """Log of the probability that Gumbel noise reaches a value that is ``-above`` away."""
    if above < -30:  # 1 - exp(-exp(x)) is exp(x)
        return above
    return float(np.log(-np.expm1(-np.exp(min(above, 700.0)))))


def _ids(v: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Ids of edge codes: characters without a piece are spelt in bytes."""
    spelt = np.flatnonzero(codes >= v.size)
    single = spelt[codes[spelt] < v.size + 128]
    codes = codes.astype(np.int64)
    codes[single] = v.byte_ids[codes[single] - v.size]
    if len(single) == len(spelt):
        return codes.astype("<u4")
    spelt = np.flatnonzero(codes >= v.size)
    parts, last = [], 0
    for i in spelt.tolist():
        parts += [codes[last:i], v.byte_ids[list(chr(codes[i] - v.size).encode("utf-8", "surrogatepass"))]]
        last = i + 1
    return np.concatenate([*parts, codes[last:]]).astype("<u4")


def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    """This Python worker's vocabulary (kept between tasks)."""
    return kept_in_worker(("vocabulary", path, alpha), lambda: Vocabulary(path, alpha))


SCHEMA = (
    "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, log_inclusion double, "
    "round_trip boolean, ids binary"
)


def sample_segmentations(
    docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, with_ids: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Up to ``k`` distinct segmentations of every row's whole text, without replacement (``SCHEMA``).

    ``alpha`` below 1 flattens the distribution. ``round_trip`` tells that
    decoding the ids gives the text (a literal U+2581 comes back as a space, as
    in the library). A null or empty text has one segmentation without ids.
    Rows without a key are drawn as key 0, rows that repeat key and text give
    equal draws. Only ``key`` and ``text`` are read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for batch in batches:
            rows: list[tuple[int | None, str]] = []
            held = 0
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""))
                held += len(rows[-1][1])
                if held >= _CHARS or i == batch.num_rows - 1:
                    yield _sampled(v, rows, k, with_ids)
                    rows, held = [], 0

    return docs.select(key, text).mapInArrow(task, SCHEMA).withColumnRenamed("doc_id", key)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()),
     ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_()), ("ids", pa.binary())]
)


def _sampled(v: Vocabulary, rows: list[tuple[int | None, str]], k: int, with_ids: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    texts = [t for _, t in rows]
    for (d, t), drawn in zip(rows, sample(v, texts, [d or 0 for d, _ in rows], k)):
        for i, (ids, phi, value, log_q) in enumerate(drawn):
            raw = ids.tobytes()
            same = v.decode(ids) == t.replace(SPACE, " ")
            out.append((d, i, len(ids), zlib.crc32(raw), phi, value, float(np.exp(log_q)), log_q, same, raw if with_ids else None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
