"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits that differ in at most ``r`` bits are linked. Equal
fingerprints are first reduced to one. A fingerprint is cut into two segments
of 32 bits, and a table holds each fingerprint under the value of each
segment. Two fingerprints within r <= 3 bits differ by at most one bit in one
of the segments: so the Hamming ball of that radius around each segment value
is enumerated (of two values at one bit the one with the bit set looks the
other up, which halves the ball), the fingerprints under each value of it are
fetched, and the complete distance decides.

A segment value that more than ``HOT`` different fingerprints share (a large
group of near copies) is not fetched. Fingerprints that stand under such a
value or look one up are compared by their whole values instead: each stands
under all values with up to 1 (r = 3: 2) flipped bits, and two within r bits
meet under one halfway between them. A key there has at most 65 different
matches (r <= 2), each linked to one nearest the key. So no bucket grows with
the data, no pairs of a large group are listed, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import checkpointed
from evalgrid.llm.components import connected_components

SEED = 42
#: Bits of a segment.
_SEGMENT = 32
#: Different fingerprints with one segment value up to which they are fetched by it.
HOT = 64
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles: A-Z lowered, words split at ASCII white space, repeats counted.

    Fewer words than ``shingle``: the whole sequence is the one shingle; no
    word (also a null text): 0. A bit is set if it is in over half the
    shingles' XXH64 values.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(body, SEED)
    # a shingle is a slice of the joined words
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(start)
    for i in range(0, n, _CHUNK):
        h = np.array([digest(body[a:b], SEED) for a, b in zip(start[i : i + _CHUNK], end[i : i + _CHUNK])], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(task, f"{key} long, fp long")


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` of ``bits``, as signed longs."""
    masks = [0] + [1 << i for i in bits]
    if most > 1:
        masks += [1 << i | 1 << j for k, i in enumerate(bits) for j in bits[:k]]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _table(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(key, fp): each fingerprint under its value with each mask's bits flipped."""
    flips = F.array(*(F.lit(m).cast("long") for m in masks))
    return fps.select("fp", F.explode(flips).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "fp")


def _segments(fps: DataFrame) -> DataFrame:
    """(segment, value, fp): each fingerprint under the value of each of its two segments."""
    low = F.col("fp").bitwiseAND(F.lit((1 << _SEGMENT) - 1).cast("long"))
    values = F.array(low, F.shiftrightunsigned("fp", _SEGMENT))
    return fps.select("fp", F.posexplode(values).alias("segment", "value")).select("segment", "value", "fp")


def _looked_up(table: DataFrame, radius: int) -> DataFrame:
    """``table`` with the values that each row looks up: its own, and for radius 1 those with one of its set bits off."""
    if radius == 0:
        return table
    masks = F.array(*(F.lit(m).cast("long") for m in _flips(list(range(_SEGMENT)), 1)))
    ball = table.select("segment", "value", "fp", F.explode(masks).alias("mask"))
    ball = ball.where(F.col("value").bitwiseAND(F.col("mask")) == F.col("mask"))
    return ball.select("segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "fp")


def links(fps: DataFrame, max_distance: int, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``fps`` (column fp, distinct).

    Every edge is at most ``max_distance`` bits long, and the edges connect
    whatever is within that distance, whatever ``hot`` is. An empty table has
    no edges.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance is 0 to 3")
    if max_distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    # a ball has some 17 rows a segment: as many tasks make it as read it
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = checkpointed(fps.select("fp").repartition(parts, "fp"))
    place, table = ["segment", "value"], _segments(spread)
    ball = _looked_up(table, max_distance // 2)
    crowded = checkpointed(table.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(*place))
    fetched = table.join(crowded, place, "left_anti").withColumnRenamed("fp", "match")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("match")))
    found = ball.join(fetched, place).where((F.col("fp") != F.col("match")) & (apart <= max_distance))
    found = found.select(F.greatest("fp", "match").alias("a"), F.least("fp", "match").alias("b"))
    among = ball.join(crowded, place, "left_semi").select("fp").distinct()
    return found.unionByName(_whole_value_links(among, max_distance, parts)).distinct()


def _whole_value_links(fps: DataFrame, max_distance: int, parts: int) -> DataFrame:
    """``links`` of fingerprints of which any number may share a segment."""
    near = max_distance // 2  # bits from the key to a possible centre; the others may be one further if r is odd
    reach = max_distance - near
    masks = _flips(list(range(64)), reach)
    # the table has dozens of rows a fingerprint: it is dealt out by key before any grouping, as keys
    # hardly repeat within a task
    table = _table(fps.repartition(parts, "fp"), masks).repartition(parts, "key")
    from_key = F.bit_count(F.col("key").bitwiseXOR(F.col("fp")))
    centre = F.min(F.when(from_key <= near, F.col("fp"))).alias("centre")
    met = table.groupBy("key").agg(F.collect_list("fp").alias("fps"), centre).where((F.size("fps") > 1) & F.col("centre").isNotNull())
    pairs = met.select("centre", F.explode("fps").alias("fp")).where("fp <> centre")
    verified = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= max_distance)
    return verified.select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``fp``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the smallest key that links reach, the row's own
    included. Null and empty texts have fingerprint 0 and are linked like any
    other. A row without a key takes part in links but names no component
    (null if no row of it has a key). Rows that repeat a key are rows of their
    own. An empty table gives no rows; other columns are not read.
    """
    printed, names = _grouped(docs, shingle, max_distance, key, text)
    return printed.join(names, "fp").select(
        F.col("doc").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, shingle: int, max_distance: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Of every row doc, h (the text's hash) and fp; of every fingerprint its component and the smallest key there."""
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc", "h", "fp"])

    printed = checkpointed(rows.mapInArrow(task, "doc long, h long, fp long"))
    distinct = printed.groupBy("fp").agg(F.min("doc").alias("least"))
    grouped = checkpointed(connected_components(links(distinct.select("fp"), max_distance)))
    # rows of a group of copies meet on their fingerprint or component: both sides of each join
    # come straight from a shuffle, so that adaptive execution can split a large group
    linked = checkpointed(distinct.join(grouped.withColumnRenamed("node", "fp"), "fp"))
    smallest = checkpointed(linked.groupBy("component").agg(F.min("least").alias("smallest")))
    joined = linked.select("fp", "component").join(smallest, "component")
    named = distinct.join(joined, "fp", "left")
    return printed, checkpointed(named.select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("smallest", "least").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``docs``, with all its columns.

    The row with the smallest key stays (a row without one only if no other
    has one), of several the one with the least hash of its text, of rows
    equal in both any one.
    """
    printed, names = _grouped(docs, shingle, max_distance, key, text)
    # what tells rows apart: key and text hash; how many rows share them
    found = printed.groupBy("doc", "h", "fp").agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found.join(names.select("fp", "component"), "fp"))
    order = F.struct(F.col("doc").isNull().alias("no_key"), "doc", "h")
    best = checkpointed(found.groupBy("component").agg(F.min(order).alias("best")))
    stays = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("h") == F.col("best.h"))
    judged = found.join(best, "component").select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), "n", stays.alias("stays"))
    marked = checkpointed(judged.where(~F.col("stays") | (F.col("n") > 1)))
    same = docs[key].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs[text]) == F.col("__h"))
    kept = docs.join(marked.select("__doc", "__h"), same, "left_anti")
    repeated = marked.where("stays").select("__doc", "__h")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, same).dropDuplicates(["__doc", "__h"]).select(*(docs[c] for c in docs.columns)))
