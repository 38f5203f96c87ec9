"""Similarity digests of improbable features.

A feature is a window of 64 bytes. Its entropy falls in one of 1024 classes,
and how often each class occurs in the whole corpus (not counting features of
a single byte value) gives its rarity. In every run of 64 neighbouring
features the rarest is the most popular there, and features that win 16 or
more runs are selected, so a local edit changes the features near it alone.
Selected features are hashed, in their order, into Bloom filters of 2048 bits,
160 features each; a full filter begins the next. Two digests are compared
filter by filter: the bits in common beyond those expected by chance, over the
most that there could be.

A text too short, or too poor in rare windows, for a selection that survives
an edit also has filters of all its windows of 8 bytes (a very short one also
of 3). The two ranges overlap: texts that are near each other have at least
one kind of filter in common, and are compared by the better one of those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RUN, POPULAR = 64, 64, 16
#: Selected features from which a text has filters of them, and up to which it also has short windows' filters,
FEWEST, ENOUGH = 1, 8
#: as have texts up to so many bytes, and those with fewer selected features than one in so many bytes.
SHORT_TEXT, SPARSE = 768, 100
#: Bytes of a short window; of the other one in texts up to so many bytes.
SHORT, SHORTEST, SHORTEST_TEXT = 8, 3, 24
CLASSES = 1024
FILTER_BITS, PER_FILTER, PROBES = 2048, 160, 5
_FILTER_BYTES = FILTER_BITS // 8
#: Bytes of a text whose features are worked out at once (a stretch needs its neighbours' overlap).
_STRETCH = 1 << 20

_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_TERM = np.zeros(WINDOW + 1)
_TERM[1:] = _COUNT[1:] * np.log2(_COUNT[1:])
#: Change of the sum of c log2 c when a count rises to c, in whole units so that sums are exact.
_UNIT = 1 << 20
_RISE = np.zeros(WINDOW + 1, np.int64)
_RISE[1:] = np.rint(np.diff(_TERM) * _UNIT).astype(np.int64)
_FULL = int(_RISE.sum())


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class 0 to 1023 of the entropy of every window of ``data`` (bytes)."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # equal bytes among the 63 before and the 63 after each byte
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    first = np.bincount(data[:WINDOW], minlength=256)
    total[0] = np.concatenate([[0], np.cumsum(_RISE[1:])])[first].sum()
    # the window at i loses byte i - 1 and gains byte i + 63
    gain = _RISE[before[WINDOW:].astype(np.int64) + 1]
    lose = _RISE[after[: n - WINDOW].astype(np.int64) + 1]
    # the byte leaves before the other comes: equal ones change nothing
    equal = data[WINDOW:] == data[: n - WINDOW]
    total[1:] = total[0] + np.cumsum(np.where(equal, 0, gain - lose))
    return (_FULL - total) * (CLASSES - 1) // _FULL


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each class, 0 the rarest; class 0 (a single byte value) is never selected.

    Classes that do not occur come last, equally frequent ones in their order.
    """
    h = histogram.astype(np.int64).copy()
    h[h == 0] = np.iinfo(np.int64).max
    h[0] = np.iinfo(np.int64).max
    out = np.empty(CLASSES, np.int64)
    out[np.lexsort((np.arange(CLASSES), h))] = np.arange(CLASSES)
    out[0] = CLASSES
    return out


def _selected(rank: np.ndarray) -> np.ndarray:
    """Positions of the features that win at least ``POPULAR`` runs (the first of equal ones wins)."""
    n = len(rank)
    run = min(RUN, n)
    order = rank * (n + 1) + np.arange(n)
    least, size = order, 1
    while size < run:
        step = min(size, run - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    wins = np.bincount(least % (n + 1), minlength=n)
    return np.flatnonzero((wins >= min(POPULAR, len(least))) & (rank < CLASSES))


def select(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the selected features of ``data``, worked out stretch by stretch."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, n, _STRETCH):
        lo, hi = max(0, at - RUN + 1), min(n, at + _STRETCH + RUN - 1)
        here = lo + _selected(rank[entropy_classes(data[lo : hi + WINDOW - 1])])
        found.append(here[(here >= at) & (here < at + _STRETCH)])
    return np.concatenate(found)


def _filters(places: np.ndarray) -> bytes:
    """Chained Bloom filters of features, given as rows of their ``PROBES`` bit places."""
    out = np.zeros((-(-len(places) // PER_FILTER), FILTER_BITS), np.uint8)
    out[np.arange(len(places))[:, None] // PER_FILTER, places % FILTER_BITS] = 1
    return np.packbits(out, axis=1, bitorder="little").tobytes()


def _windows(raw: bytes, size: int) -> np.ndarray:
    """The different windows of ``size`` (at most 8) bytes, as numbers, in the order of their first place."""
    n = len(raw) - size + 1
    values = np.ndarray((max(n, 0),), "<u8", raw + bytes(8), strides=(1,)) & np.uint64((1 << 8 * size) - 1)
    values, first = np.unique(values, return_index=True)
    return values[np.argsort(first)]


def _short_places(raw: bytes) -> np.ndarray:
    """Bit places of a text's short windows; a text shorter than one is one."""
    if len(raw) < SHORTEST:
        features = _windows(raw, len(raw)) + np.uint64(len(raw) << 56)
    else:
        features = _windows(raw, SHORT)
        if len(raw) <= SHORTEST_TEXT:
            features = np.concatenate([features, _windows(raw, SHORTEST) + np.uint64(SHORTEST << 56)])
    # splitmix64, 11 bits a probe
    x = features + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.stack([(x >> np.uint64(11 * i)).astype(np.int64) & 2047 for i in range(PROBES)], axis=1)


def _digest(raw: bytes, places: np.ndarray) -> bytes:
    """How many filters of selected features there are (4 bytes), these, and those of short windows."""
    rare = few = b""
    if len(places) >= FEWEST:
        features = list(dict.fromkeys(raw[at : at + WINDOW] for at in places.tolist()))
        hashed = b"".join([hashlib.sha1(f).digest()[: 2 * PROBES] for f in features])
        rare = _filters(np.frombuffer(hashed, ">u2").reshape(-1, PROBES))
    if len(raw) <= SHORT_TEXT or len(places) < max(ENOUGH, len(raw) // SPARSE):
        few = _filters(_short_places(raw))
    return (len(rare) // _FILTER_BYTES).to_bytes(4, "big") + rare + few


def digests(texts: list[str], rank: np.ndarray) -> list[bytes]:
    """Digest of each text: chained Bloom filters of one kind or both; an empty text has none.

    Short texts are joined, so that entropies are worked out for many at once.
    """
    raws = [t.encode() for t in texts]
    out: list[bytes] = []
    at = 0
    while at < len(raws):
        upto, size = at, 0
        while upto < len(raws) and (upto == at or size + len(raws[upto]) <= _STRETCH):
            size += len(raws[upto])
            upto += 1
        group = raws[at:upto]
        if len(group) == 1 and size > _STRETCH:
            out.append(_digest(group[0], select(np.frombuffer(group[0], np.uint8), rank)))
        else:
            ranked, start = rank[entropy_classes(np.frombuffer(b"".join(group), np.uint8))], 0
            for raw in group:
                own = ranked[start : start + max(0, len(raw) - WINDOW + 1)]
                out.append(_digest(raw, _selected(own) if len(own) else own) if raw else b"")
                start += len(raw)
        at = upto
    return out


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1, by the better of the kinds of filters that both digests have (0 if there is none).

    Two empty digests are alike (1.0), an empty one and another are not (0.0).
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(_alike(x, y) if x and y else 0.0 for x, y in zip(_kinds(a), _kinds(b)))


def _kinds(digest: bytes) -> tuple[bytes, bytes]:
    end = 4 + int.from_bytes(digest[:4], "big") * _FILTER_BYTES
    return digest[4:end], digest[end:]


def _alike(a: bytes, b: bytes) -> float:
    """Each filter of the digest with fewer (of equal ones: the other way too) meets its best match."""
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, _FILTER_BYTES), axis=1).astype(np.float32) for d in (a, b))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance, most = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    score = np.maximum(0, (x @ y.T - chance) / np.maximum(most - chance, 1e-6))
    best = score.max(axis=1).mean() if len(x) < len(y) else (score.max(axis=1).mean() + score.max(axis=0).mean()) / 2
    return float(min(1.0, best))


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy classes, by their counts over every window of all texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for t in batch.column(0):
                data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                for at in range(0, max(0, len(data) - WINDOW + 1), _STRETCH):
                    count += np.bincount(entropy_classes(data[at : at + _STRETCH + WINDOW - 1]), minlength=CLASSES)
        yield pa.RecordBatch.from_pydict({"class": pa.array(np.arange(CLASSES), pa.int32()), "n": count})

    histogram = np.zeros(CLASSES, np.int64)
    for r in docs.select(text).mapInArrow(task, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        histogram[r["class"]] = r.n
    return ranks(histogram)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (code points) replaced by as many from the start of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Keys that cut the table in ``parts`` ranges of about equal size."""
    if parts < 2:
        return []
    cuts = docs.where("doc is not null").approxQuantile("doc", [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted({int(c) for c in cuts})


def neighbours(docs: DataFrame, parts: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ranges of descending key, each range followed by the first row of the next (the last: of the first).

    Returns range, follows (true for that extra row), doc, text; partitioned by
    range and sorted within. The extra rows are one a range, or as many as
    share its key. Equal keys are in order of their texts' hashes.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bounds = _bounds(rows, parts)
    place = F.lit(len(bounds)).cast("int")
    if bounds:
        # ranges count from the largest keys down; null keys come last
        below = F.array(*(F.lit(b).cast("long") for b in bounds))
        place = F.when(F.col("doc").isNull(), place).otherwise(F.size(F.filter(below, lambda b: b >= F.col("doc"))))
    ranged = rows.withColumn("range", place)
    heads = ranged.groupBy("range").agg(F.max("doc").alias("head")).orderBy("range").collect()
    after = [(a["range"], b["head"]) for a, b in zip(heads, heads[1:] + heads[:1])]
    out = ranged.select("range", F.lit(False).alias("follows"), "doc", "text")
    if after:
        first = F.broadcast(spark.createDataFrame(after, "before int, head long"))
        extra = rows.join(first, rows["doc"].eqNullSafe(first["head"]))
        out = out.unionByName(extra.select(F.col("before").alias("range"), F.lit(True).alias("follows"), "doc", "text"))
    tie = F.xxhash64("text")
    return out.repartitionByRange(parts, "range").sortWithinPartitions(
        "range", "follows", F.col("doc").desc_nulls_last(), tie, "text"
    )


SCHEMA = (
    "doc long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
_ARROW = pa.schema(
    [("doc", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
#: Rows and characters that are worked on at once.
_ROWS, _CHARS = 128, 1 << 20


def _compared(rows: list[tuple[int | None, str]], rank: np.ndarray) -> pa.RecordBatch:
    """Results of all ``rows`` but the last, each beside the row after it."""
    texts = [t for _, t in rows]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, other = digests(texts, rank), digests(changed, rank)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(own[:-1], pa.binary()),
            pa.array(other, pa.binary()),
            pa.array(map(likeness, own, other), pa.float64()),
            pa.array(map(likeness, own, own[1:]), pa.float64()),
        ],
        schema=_ARROW,
    )


def compare_neighbours(docs: DataFrame, parts: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every row's text and edited text, and likeness to the edited and to the next row's text.

    The next row is the one after it in descending key; after the last comes
    the first, and a single row follows itself. Null keys come last, equal keys
    in order of their texts' hashes. Null texts are empty: their digest has no
    filter. Equal texts have equal digests, since only the text and the
    corpus-wide ranks enter. An empty table gives no rows; other columns are
    not read.
    """
    spark = docs.sparkSession
    rank = rarity(docs, text)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        held, closed = 0, False
        for batch in batches:
            for follows, doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if follows and closed:
                    continue
                closed = follows
                rows.append((doc, value.as_py() or ""))
                held += len(rows[-1][1])
                if follows or len(rows) > _ROWS or held > _CHARS and len(rows) > 1:
                    yield _compared(rows, rank)
                    rows = [] if follows else rows[-1:]
                    held = sum(len(t) for _, t in rows)

    out = neighbours(docs, parts, key, text).select("follows", "doc", "text").mapInArrow(task, SCHEMA)
    return out.withColumnRenamed("doc", key)
