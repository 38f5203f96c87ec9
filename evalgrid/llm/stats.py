"""Statistics of whole texts that the quality operators share.

One pass in Python per text: byte counts by ``numpy.bincount``, words by
``bytes.split`` (its white space is exactly ``[\\x20\\x09-\\x0D]``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of ``text_statistics``, all counts.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_upper", "n_lower", "n_digits", "n_pipes", "n_bangs", "n_stops", "n_commas", "n_quotes",
    "n_lines", "n_distinct_words", "n_equal_neighbours", "longest_word", "n_wide",
)
SPACE = b" \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words in a window of the repetition count.
WINDOW = 8


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at two or more places."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    # some windows may be equal: number the distinct words, then pairs, fours, eights of them, exactly
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        size += step
    found = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(found), 1)
    np.add.at(edge, np.flatnonzero(found) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """``NAMES`` of a text; a null text is empty."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(count[0x80:0xC0].sum())
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    letters = [sum(count[lo:hi].tolist()) for lo, hi in ((65, 91), (97, 123), (48, 58))]
    return (
        len(words),
        chars - sum(int(count[b]) for b in SPACE),
        sum(int(count[b]) for b in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        chars,
        *letters,
        int(count[124]),
        int(count[33]),
        int(count[46]),
        int(count[44]),
        int(count[34]) + int(count[39]),
        len(lines),
        len(set(words)),
        sum(map(bytes.__eq__, words, words[1:])),
        max(map(len, words), default=0),
        int(count[0xC0:].sum()),
    )


#: Names of the columns of ``features``.
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "pipes",
    "bangs", "stops", "commas", "quotes", "words_a_line", "distinct", "neighbours", "longest", "wide",
)


def features(stats: np.ndarray) -> np.ndarray:
    """Rates made of rows of ``NAMES``: what the models see. No count of an empty text divides by zero."""
    c = dict(zip(NAMES, np.asarray(stats, np.float64).reshape(-1, len(NAMES)).T))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]),
        c["word_chars"] / words,
        c["n_symbols"] / words,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_upper"] / letters,
        c["n_digits"] / chars,
        c["n_pipes"] / words,
        c["n_bangs"] / words,
        c["n_stops"] / words,
        c["n_commas"] / words,
        c["n_quotes"] / words,
        c["n_words"] / lines,
        c["n_distinct_words"] / np.sqrt(words),
        c["n_equal_neighbours"] / words,
        np.log1p(c["longest_word"]),
        c["n_wide"] / chars,
    ])


def schema(key: str = "doc_id long") -> str:
    return f"{key}, " + ", ".join(f"{n} long" for n in NAMES)


def batch_statistics(texts: pa.Array) -> np.ndarray:
    """``NAMES`` of each text of an Arrow column, as rows."""
    return np.array([text_statistics(t.as_py()) for t in texts], np.int64).reshape(-1, len(NAMES))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``NAMES`` of every row; only ``key`` (a long) and ``text`` are read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], names=[key, *NAMES])

    return docs.select(key, text).mapInArrow(task, schema(f"{key} long"))
