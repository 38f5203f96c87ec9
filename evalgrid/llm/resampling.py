"""Importance resampling towards a target distribution over hashed word features.

A feature is a run of 1 to ``max_n`` words; its bucket is the CRC-32 of its
bytes. CRC-32 is linear over XOR: apart from a constant for the length, the
value of a span is the XOR of one contribution for each byte, which depends on
the byte and on its distance from the span's end alone. So all spans of a
batch are hashed together: the contributions are looked up in a table (byte by
distance), and ``bitwise_xor.reduceat`` folds them span by span. A span longer
than the table is cut into blocks from its end; each block's value is advanced
by the bytes behind it, and the blocks are folded the same way.

Counts of buckets over the whole corpus and the target give each bucket's
gain, the mean gain of a document its weight, and Gumbel noise drawn from the
key a sample without replacement: the highest scores.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import checkpointed, ranked

#: Distances from the end that the table has: the bytes of a block.
BLOCK = 64
#: Bytes of texts, and bytes of blocks, that are worked on at once.
_BYTES = 1 << 20

_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected


def _steps() -> np.ndarray:
    """The register after each byte value, from zero."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = (r >> 1) ^ np.where(r & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return r


@functools.cache
def contributions() -> np.ndarray:
    """``[d, b]``: what byte b at distance d from a span's end adds to its CRC-32."""
    step = _steps()
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = step
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> 8) ^ step[out[d - 1] & 255]
    return out


def _advance(table: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Registers ``r`` after the zero bytes that ``table`` (register byte by value) stands for."""
    return table[0][r & 255] ^ table[1][r >> 8 & 255] ^ table[2][r >> 16 & 255] ^ table[3][r >> 24]


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """The table of ``_advance`` for 2**power zero bytes."""
    if power == 0:
        r = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return (r >> 8) ^ _steps()[r & 255]
    half = _zeros(power - 1)
    return np.stack([_advance(half, row) for row in half])


def advance(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each register after as many zero bytes as ``n`` says, by the binary digits of ``n``."""
    r, n = np.array(r, np.uint32), np.asarray(n, np.int64)
    for power in range(int(n.max(initial=0)).bit_length()):
        on = (n >> power & 1).astype(bool)
        r[on] = _advance(_zeros(power), r[on])
    return r


@functools.cache
def _length_constants() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


def _folded(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of 1 to ``BLOCK`` bytes, slice by slice."""
    out = np.empty(len(start), np.uint32)
    table, per = contributions().reshape(-1), _BYTES // BLOCK
    for lo in range(0, len(start), per):
        n = size[lo : lo + per]
        first = np.cumsum(n) - n
        total = int(n.sum())
        # place of each byte in data, and its distance from its span's end
        place = np.arange(total) + np.repeat(start[lo : lo + per] - first, n)
        distance = np.repeat(first + n - 1, n) - np.arange(total)
        out[lo : lo + per] = np.bitwise_xor.reduceat(table[(distance << 8) + data[place]], first)
    return out


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]`` (bytes; no span is empty; spans may overlap)."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint32)
    if size.max() <= BLOCK:
        return _folded(data, start, size) ^ _length_constants()[size]
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    span = np.repeat(np.arange(len(size)), blocks)
    behind = (np.repeat(first + blocks - 1, blocks) - np.arange(len(span))) * BLOCK  # bytes between the block and the span's end
    upto = end[span] - behind
    begin = np.maximum(upto - BLOCK, start[span])
    value = advance(_folded(data, begin, upto - begin), behind)
    ones = np.full(len(size), 0xFFFFFFFF, np.uint32)
    return np.bitwise_xor.reduceat(value, first) ^ advance(ones, size) ^ ones


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: A-Z lowered; whether it belongs to a word (letters, digits, all beyond ASCII)."""
    b = np.arange(256, dtype=np.uint8)
    upper = (b >= ord("A")) & (b <= ord("Z"))
    lowered = np.where(upper, b + 32, b).astype(np.uint8)
    inside = (b >= 128) | (lowered >= ord("a")) & (lowered <= ord("z")) | (b >= ord("0")) & (b <= ord("9"))
    return lowered, inside


_LOWERED, _INSIDE = _byte_classes()


def features(texts: pa.Array, max_n: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of stretches of ``texts``: first row, and for each row its words, for each feature its row and CRC-32.

    Rows are counted from the stretch's first. Nulls have no words. A stretch
    holds about a megabyte, or one longer text.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_of = texts.buffers()[2]
    everything = np.frombuffer(bytes_of, np.uint8) if bytes_of else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        at = offsets[lo : hi + 1] - offsets[lo]
        data = _LOWERED[everything[offsets[lo] : offsets[hi]]]
        inside = np.concatenate([[False], _INSIDE[data], [False]])
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        # a text's words end with it
        bounds = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        begins[bounds] = inside[bounds + 1]
        ends[bounds - 1] = inside[bounds]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        row = np.searchsorted(at, start, "right") - 1
        words = np.bincount(row, minlength=hi - lo)
        rows, values = [row], [span_crc32(data, start, end)]
        if max_n > 1 and len(start):
            # runs of words are spans of a copy in which one space parts the words
            size = end - start
            new = np.cumsum(size + 1) - size - 1
            body = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
            body[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside[1:-1]]
            for n in range(2, max_n + 1):
                first = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
                rows.append(row[first])
                values.append(span_crc32(body, new[first], new[first + n - 1] + size[first + n - 1]))
        yield lo, words, np.concatenate(rows), np.concatenate(values)
        lo = hi


def bucket_counts(rows: DataFrame, text: str = "text", max_n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all rows fall in each bucket; each task sends at most ``buckets`` sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, value in features(batch.column(0), max_n):
                count += np.bincount(value % buckets, minlength=buckets)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": count[held]})

    out = np.zeros(buckets, np.int64)
    for r in rows.select(text).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floor of 1000 times the log ratio of each bucket's smoothed share of the target to that of the corpus."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: str = "2024", max_n: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight and score of every row.

    ``weight`` is the floored mean gain of a row's features (0 without one),
    ``score`` adds Gumbel noise in thousandths, from the SHA-256 of seed and
    key (a null key: of the seed and nothing).
    """
    buckets = len(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for lo, words, row, value in features(batch.column(1), max_n):
                hi = lo + len(words)
                n_words[lo:hi] = words
                n_features[lo:hi] = np.bincount(row, minlength=len(words))
                # sums of whole numbers below 2**53 are exact
                total[lo:hi] = np.bincount(row, gain[value % buckets], len(words)).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long"), text).mapInArrow(task, "key long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, max_n: int = 1, buckets: int = 10_000,
    seed: str = "2024", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of ``docs``.

    Of the rows with at least ``least_words`` words, the ``percent`` per cent
    (rounded down) with the highest scores are drawn and ranked from 1; ties
    go to the smaller key, rows without a key come last, rows equal in both
    are drawn in any fixed order. Other rows have no rank.

    A null text has no features: weight 0. Repeated rows are rows of their
    own. Without target rows all target counts are 0. An empty table gives no
    rows; other columns are not read.

    The histogram of scores that finds the last drawn score has one row for
    each whole number that a score can be: gains and noise lie within some
    tens of thousands, whatever the table's size. Only rows from that score on
    are sorted, in ranges.
    """
    gain = gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, text, max_n, buckets))
    rows = checkpointed(scored(docs, gain, seed, max_n, key, text))
    # a row of its own even among equal ones; the checkpoint keeps it the same
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    able = F.col("n_words") >= least_words
    histogram = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)
    drawn = int(histogram["n"].sum()) * percent // 100
    from_top = histogram["n"].cumsum().to_numpy()
    columns = [F.col("key").alias(key), "n_words", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = int(histogram["score"].iloc[int((from_top < drawn).sum())])
    near = able & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()]
    placed = ranked(rows.where(near), order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    return placed.select(*columns, "rank").unionByName(rows.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
