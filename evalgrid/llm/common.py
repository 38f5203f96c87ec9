"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.session import ensure_checkpoint_dir, ship_package


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Make checkpoints and the package's Python code available to the executors.

    Texts go to Python in batches of ``BATCH_ROWS``, so that a task holds few
    of them at once.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


_KEPT: dict[Any, Any] = {}


def kept_in_worker(key: Any, make: Callable[[], Any]) -> Any:
    """The object that this Python worker keeps between tasks under ``key``.

    One at a time: workers are reused by other operators, whose tasks should
    not find the memory taken by tables that they have no use for.
    """
    if key not in _KEPT:
        _KEPT.clear()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any store it can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in ``spark.checkpoint.dir`` (shared, survives executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` for a table that a job writes and reads again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalgrid-llm/{name}-{uuid.uuid4().hex}"


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number (from 1) in ``order`` as column ``name``.

    Sorted in ranges of about equal size; one count a range gives the offsets
    (as many rows as there are ranges). ``order`` should tell any two rows
    apart, so that no range holds a group that cannot be cut.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the range's number, and the row's within it
    placed = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    counts, before, offsets = placed.groupBy("__range").count().orderBy("__range").collect(), 0, []
    for r in counts:
        offsets.append((r["__range"], before - (r["__range"] << 33) + 1))
        before += r["count"]
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__at", "__range")
    first = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__range long, __add long"))
    return placed.join(first, "__range").withColumn(name, F.col("__at") + F.col("__add")).drop("__at", "__range", "__add")
