"""Binary token files: frequency-ranked ids in byte-aligned variable-length coding.

A block holds whole documents in ascending key order. Its ids are replaced by
their rank of frequency in the block, so the commonest 256 take one byte and
the next 65,280 two. Lengths stand apart from the values: a control byte holds
the lengths (1 to 4 bytes) of four values. Decoding looks control bytes up in
a table of 256 x 4 lengths, whose running sum gives every value's place.

Block layout, little-endian: ``MAGIC``, then the counts of documents, ids and
distinct ids (u64 each), keys (i64), key-is-null flags (u8), ids per document
(u64), the distinct ids by descending frequency (u32), control bytes, value bytes.

Blocks are rows of a Parquet table that Spark writes: its commit protocol
covers lost executors and repeated attempts, and any store Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.llm.tokens import encoder

MAGIC = b"EGTOK001"
#: Lengths of the four values that a control byte describes, two bits each.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)

BLOCK_SCHEMA = "part int, block int, n_docs long, n_ids long, payload binary"
DOC_SCHEMA = "part int, block int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary"


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    data = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    data[at] = v & np.uint32(0xFF)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        data[at[longer] + k] = v[longer] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode_values`` wrote."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


#: Ids below this are counted in a table, without sorting them.
_TABLE = 1 << 22


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids by descending frequency (ties: ascending), and each id's rank among them."""
    if int(ids.max(initial=0)) < _TABLE:
        count = np.bincount(ids)
        distinct = np.flatnonzero(count)
        by_frequency = distinct[np.argsort(-count[distinct], kind="stable")]
        rank = np.zeros(len(count), "<u4")
        rank[by_frequency] = np.arange(len(distinct), dtype="<u4")
        return by_frequency.astype("<u4"), rank[ids]
    distinct, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(distinct), "<u4")
    rank[order] = np.arange(len(distinct), dtype="<u4")
    return distinct[order].astype("<u4"), rank[inverse]


def encode_block(keys: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    by_frequency, ranks = rank_ids(ids)
    control, data = encode_values(ranks)
    return b"".join([
        MAGIC,
        np.array([len(docs), len(ids), len(by_frequency)], "<u8").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], np.uint8).tobytes(),
        np.array([len(d) for d in docs], "<u8").tobytes(),
        by_frequency.tobytes(),
        control,
        data,
    ])


def decode_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids per document and all ids of a block."""
    if payload[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token block")
    at = len(MAGIC)

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype, n, at)
        at += out.nbytes
        return out

    n_docs, n_ids, n_distinct = (int(x) for x in take("<u8", 3))
    keys, no_key, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    by_frequency = take("<u4", n_distinct)
    control = take("u1", -(-n_ids // 4))
    data = take("u1", len(payload) - at)
    ids = by_frequency[decode_values(control, data, n_ids)] if n_ids else np.zeros(0, "<u4")
    return [None if z else int(k) for k, z in zip(keys, no_key)], sizes.astype(np.int64), ids


_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_DOC_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = 2_000_000, key: str = "doc_id", text: str = "text",
    added: bool = False,
) -> None:
    """Encode ``docs`` in ascending key order into token files under ``path``.

    Null keys come first, equal keys in order of their texts' hashes. A null
    or empty text is the end id alone. A block ends after ``block_ids`` ids,
    documents are not split. Only ``key`` and ``text`` are read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        enc, end = encoder(tokenizer, added), np.array([end_id], "<u4")
        keys, ids, held = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": part, "block": block, "n_docs": len(keys), "n_ids": held, "payload": encode_block(keys, ids)}],
                schema=_BLOCK_ARROW,
            )

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                one = np.concatenate([*enc.encode([t.as_py()]), end])
                keys.append(k.as_py())
                ids.append(one)
                held += len(one)
                if held >= block_ids:
                    yield row()
                    block, keys, ids, held = block + 1, [], [], 0
        if keys:
            yield row()

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    tie = F.xxhash64("t")
    ordered = rows.repartitionByRange(F.col("k"), tie).sortWithinPartitions("k", tie)
    ordered.mapInArrow(task, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: key, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``.

    With ``with_ids`` also ``ids`` (little-endian unsigned 32-bit).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(*(batch.column(i) for i in range(3))):
                keys, sizes, ids = decode_block(payload.as_py())
                ends = np.cumsum(sizes)
                bodies = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [part.as_py()] * len(keys),
                        "block": [block.as_py()] * len(keys),
                        "doc_id": keys,
                        "local_start": ends - sizes,
                        "n_tokens": sizes,
                        "ids_crc32": [zlib.crc32(b) for b in bodies],
                        "ids": bodies if with_ids else [None] * len(keys),
                    },
                    schema=_DOC_ARROW,
                )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # the ids before a block: those of the parts before (a row for each part, in order on the driver), and of its own part
    parts, before = [], 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r.part, before))
        before += r.n
    upto = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    within = blocks.select("part", "block", (F.sum("n_ids").over(upto) - F.col("n_ids")).alias("within"))
    starts = within.join(spark.createDataFrame(parts, "part int, before long"), "part")
    starts = starts.select("part", "block", (F.col("before") + F.col("within")).alias("first"))
    docs = blocks.select("part", "block", "payload").mapInArrow(task, DOC_SCHEMA)
    out = docs.join(starts, ["part", "block"])
    columns = ["doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*columns, *(["ids"] if with_ids else []))
