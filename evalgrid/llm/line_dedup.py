"""Line deduplication with two Bloom filters.

1. Hashes of long lines go, in compact lists, to the part of the once-seen
   filter that their leading bits name; the parts are as many as the hashes
   ask for, so a task's filter does not grow with the input. A hash that the
   filter holds already was seen twice. A list names a hash twice at most, so
   a line of very many documents weighs little.
2. The hashes seen twice make the twice-seen filter, whose size follows their
   number alone up to a bound, and which is broadcast. A line that it does
   not hold occurs in one document, so it stays where it is. Suspects alone
   are shuffled, as digest and document, for exact counts and the choice of
   the document that keeps the line.
3. Documents without a suspect are finished inside the scan; the others meet
   the digests that they lose.

False positives of the filters cost shuffled digests, not results. More
repeated lines than the bound has bits for (some 45 million different ones at
64 MB) let more and more single lines through as suspects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import checkpointed

SPACE = " \t\n\x0b\x0c\r"
#: Coarse parts of the hashes, and of the broadcast filter; a power of two.
PARTS = 64
#: Hashes, as lists name them, for each finer part of the once-seen filter (6 MB of bits).
HASHES_A_PART = 4 << 20
#: Hashes seen twice in one row of their table.
HASHES_A_ROW = 1 << 18
#: Bits of a filter for each hash, and bits that a hash sets.
BITS_A_HASH, PROBES = 12, 4
#: Bound of the twice-seen filter that is broadcast.
MOST_BYTES = 64 << 20


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line: stripped and with A-Z in lower case; None if it is shorter than ``least`` code points."""
    if len(line) < least:
        return None
    stripped = line.strip(SPACE)
    return stripped.encode().lower() if len(stripped) >= least else None


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class Bloom:
    """The part of a Bloom filter for hashes with the same leading bits."""

    def __init__(self, size: int, data: bytes | None = None):
        self.bits = np.zeros(size, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(len(self.bits) * 8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        at = self._places(hashes).reshape(-1)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int32)


def _hash_lists(docs: DataFrame, least: int) -> DataFrame:
    """(part, hashes): the hashes of each batch's lines, a list a part; of a key in more than two of its documents two."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for t in batch.column(0):
                keys = {line_key(x, least) for x in (t.as_py() or "").split("\n")}
                keys.discard(None)
                found += keys
            h = np.sort(_hashes(found))
            third = np.zeros(len(h), bool)
            third[2:] = h[2:] == h[:-2]
            h = h[~third]
            ends = np.searchsorted(_part(h), np.arange(PARTS + 1))  # sorted hashes have sorted parts
            lists = [h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "hashes": lists})

    return docs.select("text").mapInArrow(task, "part int, hashes binary")


def _finer(lists: DataFrame, bits: int) -> DataFrame:
    """The lists, each cut by ``bits`` further leading bits of its hashes."""
    if not bits:
        return lists

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes in batch.column(1):
                h = np.sort(np.frombuffer(hashes.as_py(), np.uint64))
                part, at = np.unique((h >> np.uint64(58 - bits)).astype(np.int32), return_index=True)
                cut = [x.tobytes() for x in np.split(h, at[1:])] if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cut, pa.binary())], names=["part", "hashes"])

    return lists.mapInArrow(task, "part int, hashes binary")


def _repeats(lists: DataFrame, hashes_a_part: int) -> DataFrame:
    """(part, hashes): each hash that the once-seen filter held already when it came, once, by coarse part."""
    n = (lists.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    bits = min(20, max(0, -(-n // (PARTS * hashes_a_part)) - 1).bit_length())
    parts = PARTS << bits
    part_bytes = max(64, n * BITS_A_HASH // 8 // parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, again, held = None, Bloom(part_bytes), np.zeros(0, np.uint64), 0
        waiting: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            every = np.unique(np.concatenate([again, *waiting]))
            for i in range(0, len(every), HASHES_A_ROW):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part >> bits], pa.int32()), "hashes": [every[i : i + HASHES_A_ROW].tobytes()]})

        for batch in batches:  # part by part
            for p, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    yield from rows()
                    part, once, again, held, waiting = p, Bloom(part_bytes), np.zeros(0, np.uint64), 0, []
                h = np.sort(np.frombuffer(hashes.as_py(), np.uint64))
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                single = h[first]
                waiting += [h[~first], single[once.has(single)]]
                once.add(single)
                held += len(waiting[-2]) + len(waiting[-1])
                if held > 2 * HASHES_A_ROW:
                    again, held, waiting = np.unique(np.concatenate([again, *waiting])), 0, []
        yield from rows()

    dealt = _finer(lists, bits).repartitionByRange(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(build, "part int, hashes binary")


def twice_seen(docs: DataFrame, least: int, most_bytes: int = MOST_BYTES, hashes_a_part: int = HASHES_A_PART) -> list[bytes]:
    """The twice-seen filter in ``PARTS`` parts: ``BITS_A_HASH`` bits a hash seen twice, ``most_bytes`` in all at most."""
    repeats = checkpointed(_repeats(checkpointed(_hash_lists(docs, least)), hashes_a_part))
    n = (repeats.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    part_bytes = max(64, min(most_bytes // PARTS, n * BITS_A_HASH // 8 // PARTS))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Bloom] = {}
        for batch in batches:
            for part, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                filters.setdefault(part, Bloom(part_bytes)).add(np.frombuffer(hashes.as_py(), np.uint64))
        for part, bloom in filters.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": [bloom.bits.tobytes()]})

    filled = repeats.repartitionByRange(PARTS, "part").mapInArrow(fill, "part int, bits binary").collect()
    parts = {r.part: bytes(r.bits) for r in filled}
    return [parts.get(p, b"") for p in range(PARTS)]


def _suspects(texts: list[str | None], least: int, filters: list[Bloom | None]) -> list[dict[bytes, bytes]]:
    """Of each text the suspected keys, by digest."""
    keys: list[bytes] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        own = {line_key(x, least) for x in (t or "").split("\n")}
        own.discard(None)
        keys += own
        owner += [i] * len(own)
    out: list[dict[bytes, bytes]] = [{} for _ in texts]
    h = _hashes(keys)
    part = _part(h)
    for p, f in enumerate(filters):
        at = np.flatnonzero(part == p)
        if f is None or not len(at):
            continue
        for j in at[f.has(h[at])].tolist():
            out[owner[j]][hashlib.sha256(keys[j]).digest()] = keys[j]
    return out


def dedup_lines(
    docs: DataFrame, least_chars: int = 20, min_docs: int = 3, most_bytes: int = MOST_BYTES, key: str = "doc_id", text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Documents without the lines that other documents repeat.

    A key (``line_key``) found in at least ``min_docs`` documents (2 or more)
    loses its lines in all of them but the one with the largest ``key``, which
    keeps all of its own. Returns key, ``text`` (what stays, joined by line
    ends), ``n_lines`` (before), ``n_dropped`` and, as one struct ``carried``, the ``carry`` columns.

    A null or empty text is one empty line. Rows without a key are left as
    they are and do not count as documents; rows that repeat a key are one
    document. Other columns are not read.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 or more")
    spark = docs.sparkSession
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("struct<nothing:int>")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), carried.alias("carried"))
    kind = f"carried {rows.schema['carried'].dataType.simpleString()}"
    known = rows.where("doc is not null")
    bits = spark.sparkContext.broadcast(twice_seen(known, least_chars, most_bytes))

    def filters() -> list[Bloom | None]:
        return [Bloom(0, b) if b else None for b in bits.value]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = filters()
        for batch in batches:
            found = _suspects(batch.column(1).to_pylist(), least_chars, fs)
            pairs = [(d, k) for d, own in zip(batch.column(0).to_pylist(), found) for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.binary())], names=["doc", "digest"]
            )

    pairs = checkpointed(known.mapInArrow(suspects, "doc long, digest binary"))
    repeated = checkpointed(  # so that both sides of the join below are plain shuffles, which can be split
        pairs.groupBy("digest").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    )
    lost = (
        pairs.join(repeated, "digest")
        .where("doc < keeper")
        .groupBy(F.col("doc").alias("lost_by"))
        .agg(F.collect_set("digest").alias("lost"))
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks documents that hold a suspect."""
        fs = filters()
        for batch in batches:
            marks = [bool(s) and d is not None for d, s in zip(batch.column(0).to_pylist(), _suspects(batch.column(1).to_pylist(), least_chars, fs))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=["doc", "text", "carried", "suspect"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc": [], "text": [], "n_lines": [], "n_dropped": []}
            for d, t, gone in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                lines = (t or "").split("\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if (k := line_key(x, least_chars)) is None or hashlib.sha256(k).digest() not in gone]
                for name, value in zip(out, (d, "\n".join(stay), len(lines), len(lines) - len(stay))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), batch.column(2)],
                names=["doc", "text", "n_lines", "n_dropped", "carried"],
            )

    marked = rows.mapInArrow(split, f"doc long, text string, {kind}, suspect boolean")
    body = F.coalesce("text", F.lit(""))
    untouched = marked.where(~F.col("suspect")).select(
        "doc", body.alias("text"), (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "carried"
    )
    shared = marked.where("suspect").join(lost, F.col("doc") == F.col("lost_by"), "left").select("doc", "text", "carried", "lost")
    schema = f"doc long, text string, n_lines long, n_dropped long, {kind}"
    done = untouched.unionByName(shared.mapInArrow(rewrite, schema))
    return done.select(F.col("doc").alias(key), F.col("text").alias(text), "n_lines", "n_dropped", *(["carried"] if carry else []))
