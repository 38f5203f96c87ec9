"""Hierarchical multi-length packing of documents into training sequences.

Each scan task packs its own documents, in groups of about ``group_tokens``:
no shuffle, and a group's tokens are the most that a task holds.

1. Whole windows of the longest tier are cut from long documents.
2. What is left of a document goes to the smallest tier that holds it.
3. Each tier is packed, the longest first: a piece opens a window of its
   tier's length, the gap takes the largest shorter pieces that fit, and when
   none fits a piece is cut to fill it to the last token.
4. Pieces that a group cannot fill a window with stay for the next group; the
   last of a task are closed as sequences of power-of-two lengths.

So every sequence has a power-of-two length and no padding. The sequences of
a group are then dealt to step groups, longest first to the group with the
least attention cost, so that steps cost about the same.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from evalgrid.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length int, tier int, step_group long, ids binary"
)


class _Pieces:
    """Pieces waiting in their tiers; each tier is kept in order of length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def add(self, length: int, doc: int, start: int) -> None:
        tier = next(t for t in self.tiers if length <= t)
        bisect.insort(self.waiting[tier], (length, doc, start))

    def largest(self, room: int) -> tuple[int, int, int] | None:
        """Take the largest waiting piece of at most ``room`` tokens."""
        for t in reversed(self.tiers):
            row = self.waiting[t]
            at = bisect.bisect_right(row, (room, 1 << 62, 0))
            if at:
                return row.pop(at - 1)
        return None

    def shortest(self) -> tuple[int, int, int] | None:
        for t in self.tiers:
            if self.waiting[t]:
                return self.waiting[t].pop(0)
        return None

    def total(self) -> int:
        return sum(p[0] for row in self.waiting.values() for p in row)


def _fill(pieces: _Pieces, size: int, opened: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fill a window of ``size`` that ``opened`` begins; the pieces left must suffice."""
    window, room = opened, size - sum(p[0] for p in opened)
    while room:
        piece = pieces.largest(room)
        if piece is None:
            length, doc, start = pieces.shortest()
            piece = (room, doc, start)
            pieces.add(length - room, doc, start + room)
        window.append(piece)
        room -= piece[0]
    return window


def pack(pieces: _Pieces, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of (tier, [(length, doc, start), ...]); with ``last``, all that waits is closed."""
    left = pieces.total()
    for size in reversed(pieces.tiers):
        while pieces.waiting[size] and left >= size:
            yield size, _fill(pieces, size, [pieces.waiting[size].pop()])
            left -= size
    while last and left:
        size = min(1 << (left.bit_length() - 1), pieces.tiers[-1])
        yield size, _fill(pieces, size, [])
        left -= size


def _step_groups(sequences: list[int], per_step: int) -> list[int]:
    """Step group of each sequence length: equal attention cost (length squared plus a linear part)."""
    n = max(1, round(sum(sequences) / per_step))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: -sequences[i]):
        cost, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (cost + sequences[i] * (sequences[i] + 4096), g))
    return out


class _Task:
    """Packs the documents of one task; ``first`` numbers its sequences and step groups."""

    def __init__(self, first: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
        self.next_sequence, self.next_step = first, first
        self.pieces, self.tiers = _Pieces(tiers), tiers
        self.step_tokens, self.with_ids = step_tokens, with_ids
        self.docs: dict[int, tuple[int | None, object]] = {}
        self.whole: list[tuple[int, int]] = []
        self.n_docs = self.held = 0

    def add(self, doc_id: int | None, ids) -> None:
        doc, size = self.n_docs, self.tiers[-1]
        self.n_docs += 1
        self.docs[doc] = (doc_id, ids)
        self.held += len(ids)
        whole = len(ids) // size * size
        self.whole += [(doc, start) for start in range(0, whole, size)]
        if whole < len(ids):
            self.pieces.add(len(ids) - whole, doc, whole)

    def close(self, last: bool) -> pa.RecordBatch:
        size = self.tiers[-1]
        windows = [(size, [(size, doc, start)]) for doc, start in self.whole]
        windows += pack(self.pieces, last)
        self.whole = []
        steps = _step_groups([n for n, _ in windows], self.step_tokens)
        rows: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for (n, window), step in zip(windows, steps):
            offset = 0
            for length, doc, start in window:
                doc_id, ids = self.docs[doc]
                body = ids[start : start + length].tobytes()
                for name, value in zip(
                    rows,
                    (doc_id, start, length, zlib.crc32(body), len(ids), self.next_sequence, offset, n,
                     next(t for t in self.tiers if n <= t), self.next_step + step, body if self.with_ids else None),
                ):
                    rows[name].append(value)
                offset += length
            self.next_sequence += 1
        self.next_step += max(steps, default=-1) + 1
        waiting = {p[1] for row in self.pieces.waiting.values() for p in row}
        self.docs = {d: self.docs[d] for d in waiting}
        self.held = sum(len(ids) for _, ids in self.docs.values())
        return pa.RecordBatch.from_pydict(rows, schema=_ARROW)


_ARROW = pa.schema(
    [
        (n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t])
        for n, t in (f.split() for f in SCHEMA.split(", "))
    ]
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = 2_000_000,
    step_tokens: int = 64 * 2048,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
    added: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences; one row per piece (``SCHEMA``).

    A document is its ids and ``end_id``; a null or empty text is the end id
    alone. Rows with a null key and repeated rows are documents of their own.
    A very long text gives many windows. An empty table gives no rows. Only
    ``key`` and ``text`` are read, whatever other columns are called. With
    ``with_ids`` each row carries its ids (little-endian unsigned 32-bit).
    ``tiers`` are ascending powers of two.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        work = _Task(TaskContext.get().partitionId() << 40, tiers, step_tokens, with_ids)
        enc, end = encoder(tokenizer, added), np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, t in zip(batch.column(0), batch.column(1)):
                work.add(doc_id.as_py(), np.concatenate([*enc.encode([t.as_py()]), end]))
                if work.held >= group_tokens:
                    yield work.close(last=False)
        if work.docs:
            yield work.close(last=True)

    return docs.select(key, text).mapInArrow(task, SCHEMA)
