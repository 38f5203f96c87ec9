"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Every row gets a global row number 0..N-1 from the data alone (rank of its
key's hash, so no input order matters). A keyed Feistel network permutes the
numbers; numbers that leave 0..N-1 walk their cycle until they return. The
position p gives shard ``p % n_shards`` and slot ``p / n_shards``, so shard
sizes differ by one row at most and a row's place can be computed, both ways,
from its number alone (``locate``, ``row_number_at``).

Only DataFrame functions: two narrow shuffles (bucket counts and the rank
within a bucket); text never leaves the scan.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
#: Ranks are taken within 2**BUCKET_BITS hash ranges, whose offsets are broadcast: a fixed number of rows.
BUCKET_BITS = 14
#: Steps of cycle walking before the job stops with an error. One step leaves the range with a
#: probability below 1/sqrt(N), and for N up to WALK**2 no walk can be longer.
WALK = 64


def _round(value: Column, r: int, seed: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.lit(r).cast("long"), value), modulus)


def _permute(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass over the a x b domain: alternate modular additions to the two halves."""
    left, right = _div(x, b), F.pmod(x, b)
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = F.pmod(left + _round(right, r, seed, a), a)
        else:
            right = F.pmod(right + _round(left, r, seed, b), b)
    return left * b + right


def _div(x: Column, y: Column) -> Column:
    """Integer quotient of non-negative longs."""
    return ((x - F.pmod(x, y)) / y).cast("long")


def numbered(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` (0..N-1) and ``n_rows``.

    Rows are ranked by the hash of ``key`` (rows without a key: of ``ties``),
    then by key and ``ties``; rows equal in all of these are interchangeable.
    The rank is taken within hash ranges, and a table of 2**BUCKET_BITS range
    counts gives their offsets: no task ranks all rows.
    """
    no_key = F.col(key).isNull()
    hashed = rows.withColumn("__h", F.xxhash64(key, *(F.when(no_key, F.col(c)) for c in ties)))
    hashed = hashed.withColumn("__bucket", F.shiftrightunsigned("__h", 64 - BUCKET_BITS).cast("int"))
    counts = hashed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.orderBy("__bucket")
    offsets = counts.select(
        "__bucket",
        (F.sum("__n").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    within = Window.partitionBy("__bucket").orderBy("__h", key, *ties)
    return (
        hashed.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("row_number", F.col("__before") + F.col("__rank") - 1)
        .drop("__h", "__bucket", "__rank", "__before")
    )


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``position``: the Feistel permutation of ``row_number`` within 0..n_rows-1."""
    n = F.col("n_rows")
    out = rows.withColumn("__a", F.ceil(F.sqrt(n.cast("double"))).cast("long"))
    out = out.withColumn("__b", _div(n + F.col("__a") - 1, F.col("__a")))
    a, b = F.col("__a"), F.col("__b")
    out = out.withColumn("__l", _div(F.col("row_number"), b)).withColumn("__r", F.pmod("row_number", b))
    for r in range(ROUNDS):
        if r % 2 == 0:
            out = out.withColumn("__l", F.pmod(F.col("__l") + _round(F.col("__r"), r, seed, a), a))
        else:
            out = out.withColumn("__r", F.pmod(F.col("__r") + _round(F.col("__l"), r, seed, b), b))
    out = out.withColumn("__x", F.col("__l") * b + F.col("__r"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.col("__x"),
        lambda x, _: F.when(x < F.col("n_rows"), x).otherwise(_permute(x, F.col("__a"), F.col("__b"), seed)),
    )
    out = out.withColumn("__x", F.when(F.col("__x") < n, F.col("__x")).otherwise(walked))
    stop = F.raise_error(F.lit("cycle walking did not return to the range")).cast("long")
    return out.withColumn("position", F.when(F.col("__x") < n, F.col("__x")).otherwise(stop)).drop(
        "__a", "__b", "__l", "__r", "__x"
    )


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20240229, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, row_number, position, shard and slot of every row.

    A null text counts as empty (size 8, crc32 0). Rows without a key and
    repeated rows are placed like any other, each in a slot of its own; equal
    rows may trade places. An empty table gives no rows. Other columns of
    ``docs``, whatever their names, are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = permuted(numbered(rows, "__key", ["size", "text_crc32"]), seed)
    return placed.select(
        F.col("__key").alias(key),
        "size",
        "text_crc32",
        "row_number",
        "position",
        F.pmod("position", F.lit(n_shards)).cast("int").alias("shard"),
        _div(F.col("position"), F.lit(n_shards).cast("long")).alias("slot"),
    )


def _hash(seed: int, r: int, value: int) -> int:
    h = 42
    for x in (seed, r, value):
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def _sides(n: int) -> tuple[int, int]:
    a = math.ceil(math.sqrt(float(n)))
    return a, -(-n // a)


def locate(row_number: int, n_rows: int, n_shards: int = 24, seed: int = 20240229) -> tuple[int, int]:
    """Shard and slot of a row number, computed without the table."""
    a, b = _sides(n_rows)
    x = row_number
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + _hash(seed, r, right) % a) % a
            else:
                right = (right + _hash(seed, r, left) % b) % b
        x = left * b + right
        if x < n_rows:
            return x % n_shards, x // n_shards


def row_number_at(shard_no: int, slot: int, n_rows: int, n_shards: int = 24, seed: int = 20240229) -> int:
    """The row number found in a shard's slot: the inverse of ``locate``."""
    a, b = _sides(n_rows)
    x = slot * n_shards + shard_no
    while True:
        left, right = divmod(x, b)
        for r in reversed(range(ROUNDS)):
            if r % 2 == 0:
                left = (left - _hash(seed, r, right) % a) % a
            else:
                right = (right - _hash(seed, r, left) % b) % b
        x = left * b + right
        if x < n_rows:
            return x
