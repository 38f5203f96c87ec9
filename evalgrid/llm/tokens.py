"""Exact token ids by the ``tokenizers`` library, with a bounded cache of encoded words.

Byte-level BPE of this kind first splits a text by a fixed pattern in which
no pre-token holds white space after other characters. So a text may be cut
before every space that follows a non-space, and each cut piece encodes as it
would inside the whole text. The pieces of natural text repeat, so each worker
keeps the ids of those seen lately, and only new ones go through the library's
splitter and model.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

from evalgrid.llm.common import kept_in_worker

_CUT = re.compile(r"(?<=\S)(?= )")
#: Pieces longer than this are encoded but not kept.
_LONGEST_KEPT = 64
#: Memory of a kept word beside its characters and ids: two objects and its place in the table.
_WORD_COST = 190
#: Memory that a worker's kept words take at most: about a million words.
KEPT_BYTES = 208 << 20
#: Characters whose class is beyond doubt: Latin letters, ASCII digits, signs and line ends.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[{_LETTER}\n!-~]+")
_LETTERS = re.compile(rf"[{_LETTER}]+")
#: Marks that end many words: pre-tokens of their own after letters.
_MARKS = frozenset(".,!?;:")
#: The splitting pattern of byte-level BPE over these characters.
_PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
)


def _byte_chars() -> list[str]:
    """Byte-level BPE's printable character for each byte: itself if printable in Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in shown)
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [chars[b] for b in range(256)]


_BYTE_CHARS = _byte_chars()
_SHOWN = dict(enumerate(_BYTE_CHARS))
_SPACE = _BYTE_CHARS[32]
#: Byte-level characters of a space and of Latin letters.
_IN_WORDS = {_SPACE, *(_BYTE_CHARS[b] for c in map(chr, range(0x250)) if _LETTERS.fullmatch(c) for b in c.encode())}


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _SpaceRun(Exception):
    """White space (of any kind that Python knows) before a space: rare, needs the exact cut."""


class _Words(dict[str, bytes]):
    """Ids of a space and each word; words that are looked up and not held gather in ``missed``.

    No word is empty or ends with white space, so looking words up also tells
    that no space follows white space.
    """

    __slots__ = ("missed",)

    def __init__(self) -> None:
        self.missed: list[str] = []

    def __missing__(self, word: str) -> None:
        if not word or word[-1].isspace():
            raise _SpaceRun
        self.missed.append(word)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; keeps the ids of words in at most ``keep`` bytes.

    With ``added``, the file's added tokens inside a text become their ids, as
    the library does by default; else their strings are ordinary text.
    """

    def __init__(self, path: str, keep: int = KEPT_BYTES, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        kind = json.loads(self._tok.to_str())
        split = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or kind["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        tokens = kind["added_tokens"] if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self._added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in tokens}
        # at one place the longest wins
        self._find_added = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if tokens else None
        self._model, self._split = self._tok.model, self._tok.pre_tokenizer
        self._keep = keep
        self._model._resize_cache(0)  # words are kept here
        self._packed = [int(i).to_bytes(4, "little") for i in range(self._tok.get_vocab_size())]
        # words may be merged in one string if no token of these bytes holds a space after others: no merge crosses them then
        tokens = [self._tok.id_to_token(i) or "" for i in range(len(self._packed))]
        self._opens = [t.startswith(_SPACE) for t in tokens]
        own = kind["model"]
        self._join = not any(_SPACE in t.lstrip(_SPACE) and _IN_WORDS.issuperset(t) for t in tokens) and not any(
            own.get(x) for x in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
        )
        self._parts: dict[str, bytes] = {}
        self._new, self._old = _Words(), _Words()
        self._held = 0  # bytes of the newer words

    def _merge(self, chars: str) -> bytes:
        """Ids of one pre-token, given as byte-level characters."""
        packed = self._packed
        return b"".join([packed[t.id] for t in self._model.tokenize(chars)])

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece that stands at the start of a text or after a cut."""
        return b"".join([self._merge(chars) for chars, _ in self._split.pre_tokenize_str(piece)])

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``. In plain words the pre-tokens are found here, in others by the library."""
        if word.isascii() and word.isalpha():
            return self._merge(_SPACE + word)
        core, mark = (word[:-1], word[-1]) if word[-1:] in _MARKS else (word, "")
        if core.isalpha() and _LETTERS.fullmatch(core):
            if not mark:
                return self._merge(_SPACE + word.encode().decode("latin-1").translate(_SHOWN))
            end = self._parts.get(mark)
            if end is None:
                end = self._parts[mark] = self._merge(mark)
            return (self._new.get(core) or self._learn(core)) + end
        if not _PLAIN.fullmatch(word):
            return self._ids(" " + word)
        out = []
        for t in _PRE_TOKEN.findall(" " + word):
            if t[0] == " " and t[1:].isalpha() and t[1:] != word:
                out.append(self._new.get(t[1:]) or self._learn(t[1:]))
                continue
            ids = self._parts.get(t)
            if ids is None:
                ids = self._merge("".join([_BYTE_CHARS[b] for b in t.encode()]))
                if len(t) <= 4 and len(self._parts) < 60_000:
                    self._parts[t] = ids
            out.append(ids)
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        """Ids of a word that is not among the newer ones."""
        ids = self._old.get(word) or self._word(word)
        self._put(word, ids)
        return ids

    def _put(self, word: str, ids: bytes) -> None:
        """Keep a word's ids; two generations bound what is kept."""
        if len(word) <= _LONGEST_KEPT:
            if self._held >= self._keep // 2:
                self._old, self._new, self._held = self._new, _Words(), 0
            self._new[word] = ids
            self._held += _WORD_COST + len(word) + len(ids)

    def _learn_letters(self, words: list[str]) -> None:
        """Keep the ids of words of Latin letters, or of what stands before their last mark: all merged by one call."""
        new, old, chars = self._new, self._old, {}
        for word in words:
            if word.isascii() and word.isalpha():
                if word not in old:
                    chars[word] = _SPACE + word
                continue
            core = word[:-1] if word[-1] in _MARKS else word
            if core.isalpha() and core not in new and core not in old and _LETTERS.fullmatch(core):
                chars[core] = _SPACE + (core if core.isascii() else core.encode().decode("latin-1").translate(_SHOWN))
        packed, opens = self._packed, self._opens
        ids = [t.id for t in self._model.tokenize("".join(chars.values()))]
        raw = b"".join([packed[i] for i in ids])
        starts = [4 * n for n, i in enumerate(ids) if opens[i]]
        for word, a, b in zip(chars, starts, [*starts[1:], len(raw)]):
            self._put(word, raw[a:b])

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), as ``<u4`` arrays."""
        return [np.frombuffer(self._text(text), "<u4") if text else np.zeros(0, "<u4") for text in texts]

    def _text(self, text: str) -> bytes:
        """Ids of a text: those of its added tokens, and of the parts between them."""
        if not self._find_added or not self._find_added.search(text):
            return self._part(text)
        out, at = [], 0
        for m in self._find_added.finditer(text):
            out += [self._part(text[at : m.start()]), self._added[m.group()]]
            at = m.end()
        return b"".join([*out, self._part(text[at:])])

    def _part(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        first, *words = text.split(" ")
        if not words:
            return self._ids(first)
        last = words.pop()
        try:
            if first[-1:].isspace():
                raise _SpaceRun
            new = self._new
            found = list(map(new.__getitem__, words))
            if new.missed:
                missed, new.missed = new.missed, []
                if self._join:
                    self._learn_letters(missed)
                found = [self._new.get(w) or self._learn(w) if ids is None else ids for w, ids in zip(words, found)]
        except _SpaceRun:
            self._new.missed = []
            first, *words = _CUT.split(text)
            words = [w[1:] for w in words]  # all but the first begin with a space
            last = words.pop() if words else None
            found = [self._new.get(w) or self._learn(w) for w in words]
        if last is not None:
            kept = last and not last[-1].isspace()
            found.append(self._new.get(last) or self._learn(last) if kept else self._word(last))
        return (self._ids(first) if first else b"") + b"".join(found)


def encoder(path: str, added: bool = False) -> Encoder:
    """This Python worker's encoder for a vocabulary file (kept between tasks)."""
    return kept_in_worker(("encoder", path, added), lambda: Encoder(path, added=added))
