"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE`` most frequent runs of 1 to 3 characters, in order
of frequency, of lower-cased letters with one space between words. A document
is compared with each language by the out-of-place distance: how far each of
its grams stands from the gram's place in the language's profile, ``PROFILE``
for a gram that is not there. The nearest language is predicted.

Grams are packed in one whole number (21 bits a character), so that a text's
counts are one sort of numbers.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grams of a profile.
PROFILE = 400
#: Learnt documents of a language at most, by the hash of their key.
SAMPLE_ROWS = 3_000
#: Characters of a text that are counted at once.
_STRETCH = 1 << 18
_SPACE, _BITS = 32, 21


@functools.cache
def _folded() -> np.ndarray:
    """Code point to counted character: letters lowered, marks as they are, all else a space."""
    out = np.full(sys.maxunicode + 1, _SPACE, np.int64)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif c > 127 and unicodedata.category(s)[0] == "M":
            out[c] = c
    return out


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _counted(points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams that end in ``points`` and their counts; ``last`` are the two characters before."""
    t = np.concatenate([last, points])
    three = (t[:-2] << 2 * _BITS) | (t[1:-1] << _BITS) | t[2:]
    two, one = three & ((1 << 2 * _BITS) - 1), points
    # a space stands at a gram's ends only, and is none of its own
    inner, end = t[1:-1] != _SPACE, points != _SPACE
    grams = np.concatenate([one[end], two[inner | end], three[inner]])
    return np.unique(grams, return_counts=True)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of a text, ascending, and their counts; none in a text without a letter.

    Worked out in stretches, each with the two characters before it.
    """
    parts, last, any_letter = [], np.array([_SPACE, _SPACE]), False
    for at in range(0, len(text), _STRETCH):
        raw = np.frombuffer(text[at : at + _STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter = any_letter or bool(_letters()[raw].any())
        points = _folded()[raw]
        # one space between words
        blank = points == _SPACE
        points = points[~(blank & np.concatenate([[last[-1] == _SPACE], blank[:-1]]))]
        if at + _STRETCH >= len(text) and (points[-1] if len(points) else last[-1]) != _SPACE:
            points = np.append(points, _SPACE)
        if len(points):
            parts.append(_counted(points, last))
            last = np.concatenate([last, points])[-2:]
    if not any_letter:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent grams in order; equal counts by the packed number."""
    if len(grams) > 4 * size:  # only those that can be among them are sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Languages in order, all grams of their profiles, and each gram's place in each profile (``size`` if absent)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    places: np.ndarray
    size: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's gram order to each language."""
        if not len(self.grams):
            return np.full(len(self.languages), self.size * len(own), np.int64)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = self.places[:, at[known]]
        apart = np.where(places < self.size, np.abs(places - np.flatnonzero(known)), self.size)
        return apart.sum(axis=1) + self.size * int((~known).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer than the farthest a profile can be (``und``, 0 without a letter or a profile)."""
        own = most_frequent(*gram_counts(text or ""), self.size)
        if not len(own) or not self.languages:
            return "und", 0.0
        d = self.distances(own)
        best = int(d.argmin())
        return self.languages[best], 1.0 - float(d[best]) / (self.size * len(own))


def profiles(orders: dict[str, list[int]], size: int = PROFILE) -> Profiles:
    """From each language's grams in order of frequency."""
    languages = tuple(sorted(orders))
    grams = np.unique(np.array([g for o in orders.values() for g in o], np.int64))
    places = np.full((len(languages), len(grams)), size, np.int64)
    for i, language in enumerate(languages):
        places[i, np.searchsorted(grams, np.array(orders[language], np.int64))] = np.arange(len(orders[language]))
    return Profiles(languages, grams, places, size)


def held_out(key: str = "doc_id") -> Column:
    """True for rows whose language is not learnt: CRC-32 of the key's digits leaves 2 modulo 4 (or there is no key)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_profiles(
    docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int = PROFILE
) -> Profiles:
    """Profiles from at most ``rows`` documents of each language (those with the least hash of their key).

    Give only rows that may be learnt. Rows without a language, key or text
    are not learnt; rows that repeat a key count once. A language
    whose documents have no letter has no profile.
    """
    named = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    keys = named.select("key", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    chosen = named.join(F.broadcast(keys.select("key", "lang")), ["key", "lang"]).dropDuplicates(["key", "lang"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(language, []).append(gram_counts(value.as_py()))
            for language, parts in held.items():
                grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([language] * len(grams), pa.string()), "gram": pa.array(grams, pa.int64()), "n": n})

    counts = chosen.select("lang", "text").mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= size)
    orders: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "place").collect():
        orders.setdefault(r.lang, []).append(r.gram)
    return profiles(orders, size)


def predict_languages(docs: DataFrame, model: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` (0 to 1) of every row.

    ``und`` with score 0 for a null text, one without a letter, and if there
    are no profiles. Equally near languages: the first by name. Null keys and
    repeated rows are judged like any other; texts of any length are worked
    through in stretches; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(task, f"{key} long, lang_pred string, score double")
