"""Row numbers and neighbours within groups.

Both are window functions: lazy, and rows whose group key is NULL form a group
of their own. A group that may hold a large share of all rows needs more than
one task; for it the caller names a ``bucket``, a column that rises with the
first order column (a block of ids, an hour of a timestamp), or has
``with_quantile_bucket`` make one. The window then runs within (group,
bucket), and a table with one row per (group, bucket) supplies what comes
before each bucket. Nothing runs until the result is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL matching NULL, keeping the left keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*(f"__r_{k}" for k in keys))


#: Stretches that a long group is cut into: each of its rows is compared with so many bounds at most.
STRETCHES = 256


def with_quantile_bucket(
    df: DataFrame, partition_cols: Sequence[str], order_col: str, out: str, long_group: int = 200_000, stretches: int = STRETCHES
) -> DataFrame:
    """Add ``out``: a bucket that rises with ``order_col`` and cuts groups of more than ``long_group`` rows.

    Only rows of such groups (at most total / ``long_group``) enter the
    quantile sketches, which are merged before and after the shuffle. A row's
    bucket is the number of its group's bounds below its ``order_col``, 0 in
    all other groups; so rows of a group that are equal in ``order_col`` share
    one. ``order_col`` is a number, date or timestamp; NULL is in bucket 0, as
    it sorts first. The bounds are approximate; any bounds give right results.
    """
    keys = list(partition_cols)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > long_group).drop("__n")
    marks = F.array(*(F.lit(i / stretches) for i in range(1, stretches)))
    long_rows = _by_keys(df.select(*keys, order_col), sizes, keys, "left_semi")
    bounds = long_rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order_col, marks, F.lit(10_000))).alias("__bounds"))
    below = F.size(F.filter("__bounds", lambda b: b < F.col(order_col)))
    return _by_keys(df, bounds, keys, "left").withColumn(out, F.when(F.col(order_col).isNotNull() & F.col("__bounds").isNotNull(), below).otherwise(0)).drop("__bounds")


def row_number_within(
    df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence, out: str = "rn", bucket: Column | None = None
) -> DataFrame:
    """Add ``out``: the 1-based position of each row in ``order_cols`` order within ``partition_cols``.

    ``order_cols`` may hold names or sort Columns; callers make the order
    unique, else the numbers of equal rows may swap. ``bucket`` never falls
    while the order rises.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    if bucket is None:
        window = Window.partitionBy(*partition_cols).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("long"))
    keys = [*partition_cols, "__bucket"]
    marked = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(*partition_cols).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = marked.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = _by_keys(numbered, offsets, keys)
    return joined.withColumn(out, F.col("__before") + F.col("__rn")).drop("__bucket", "__rn", "__before")


def previous_within(
    df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str], columns: dict[str, str], bucket: Column | None = None
) -> DataFrame:
    """Add for each (source, name) of ``columns`` the value of the row before, NULL in a group's first row."""
    taken = F.struct(*(F.col(c).alias(n) for c, n in columns.items()))
    keys = [*partition_cols, "__bucket"]
    marked = df.withColumn("__bucket", bucket if bucket is not None else F.lit(0))
    out = marked.withColumn("__prev", F.lag(taken).over(Window.partitionBy(*keys).orderBy(*order_cols)))
    if bucket is not None:
        last = marked.groupBy(*keys).agg(F.max_by(taken, F.struct(*order_cols)).alias("__last"))
        earlier = F.lag("__last").over(Window.partitionBy(*partition_cols).orderBy("__bucket"))
        out = _by_keys(out, last.select(*keys, earlier.alias("__earlier")), keys)
        out = out.withColumn("__prev", F.coalesce("__prev", "__earlier")).drop("__earlier")
    return out.select(*df.columns, *(F.col("__prev")[n].alias(n) for n in columns.values()))
