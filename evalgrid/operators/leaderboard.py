"""Leaderboard: latest run per (model, task file), ranked.

"Latest per group" is an aggregate (``max_by``), not a window: it has a
map-side partial step, so a (model, task file) pair with a third of all
summary rows is reduced on every map task before the shuffle. Ranking runs
on the deduplicated table, which has one row per (model, task file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.functions.text import fixed
from evalgrid.operators.sequence import row_number_within

GROUP_KEYS = ("model_config_id", "task_file")
LEADERBOARD_COLUMNS = [
    "model_config_id", "task_file", "total_tasks", "total_attempts", "repeats",
    "pass_rate", "average_score", "average_latency_sec",
]

# The report title, header and alignment row.
TITLE = "# Local Model Benchmark Leaderboard"
HEADER = "| Model Config | Task File | Total Tasks | Total Attempts | Repeats | Pass Rate | Avg Score | Avg Latency |"
ALIGN = "|---|---:|---:|---:|---:|---:|---:|---:|"
EMPTY = "No data yet."


def latest_per_group(
    df: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    order: str = "run_id",
    ingest_seq: str | None = None,
) -> DataFrame:
    """Keep the row with the greatest ``order`` value per ``keys``.

    Ties on ``order`` go to the lowest ``ingest_seq`` (first in the input),
    when given; otherwise to the greatest remaining row (deterministic).
    """
    cols = df.columns
    if ingest_seq:  # of rows with equal keys and order the first, then the greatest order: two partial aggregations
        first = df.groupBy(*keys, order).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(ingest_seq)).alias("__first"))
        df = first.select(*[F.col("__first")[c].alias(c) for c in cols])
    rank_key = [F.col(order), *(F.col(c) for c in cols if c not in keys and c != order and c != ingest_seq)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*rank_key)).alias("__best"))
    return best.select(*[F.col("__best")[c].alias(c) for c in cols])


def parse_summary_text(df: DataFrame) -> DataFrame:
    """Typed summary rows from the all-strings CSV form (current or old header).

    A missing ``total_attempts`` column (or blank cell) defaults to
    ``total_tasks``, a missing ``repeats`` to 1.
    """
    def col_or_null(c: str):
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    def num(c: str, t: str):
        return F.expr(f"try_cast(nullif(trim(`{c}`), '') AS {t})") if c in df.columns else F.lit(None).cast(t)

    out = df.select(
        col_or_null("run_id").alias("run_id"),
        col_or_null("model_config_id").alias("model_config_id"),
        col_or_null("task_file").alias("task_file"),
        num("total_tasks", "bigint").alias("total_tasks"),
        F.coalesce(num("total_attempts", "bigint"), num("total_tasks", "bigint")).alias("total_attempts"),
        num("passed", "bigint").alias("passed"),
        num("failed", "bigint").alias("failed"),
        num("pass_rate", "double").alias("pass_rate"),
        num("average_score", "double").alias("average_score"),
        num("average_latency_sec", "double").alias("average_latency_sec"),
        F.coalesce(num("repeats", "int"), F.lit(1)).alias("repeats"),
        *([F.col("__seq")] if "__seq" in df.columns else []),
    )
    return out


def leaderboard(summary: DataFrame, ingest_seq: str | None = None) -> DataFrame:
    """Latest run per (model, task file), sorted by score desc, pass rate desc, latency asc.

    ``model_config_id, task_file`` are explicit final tie-breakers (Spark's
    sort is not stable, so input order is never relied on). Rows with equal
    run ids go to the lowest ``ingest_seq`` (``__seq`` when present).
    """
    if ingest_seq is None and "__seq" in summary.columns:
        ingest_seq = "__seq"
    cols = [c for c in summary.columns]
    latest = latest_per_group(summary.select(*cols), GROUP_KEYS, "run_id", ingest_seq)
    return latest.select(*LEADERBOARD_COLUMNS).orderBy(*sort_order())


def sort_order():
    return [
        F.col("average_score").desc(), F.col("pass_rate").desc(), F.col("average_latency_sec").asc(),
        F.col("model_config_id").asc(), F.col("task_file").asc(),
    ]


def markdown_rows(board: DataFrame) -> DataFrame:
    """The rendered table: (line_no, line), title and header included.

    Body rows (one per model and task file, after the aggregation) are
    numbered in rank order by a window; the header lines are a constant
    four-row frame unioned on top.
    """
    ranked = row_number_within(board, [], sort_order(), out="__rank")
    body = ranked.select(
        (F.col("__rank") + F.lit(4)).alias("line_no"),
        F.concat(
            F.lit("| "), F.col("model_config_id"), F.lit(" | "), F.col("task_file"), F.lit(" | "),
            F.col("total_tasks").cast("string"), F.lit(" | "), F.col("total_attempts").cast("string"), F.lit(" | "),
            F.col("repeats").cast("string"), F.lit(" | "),
            fixed("pass_rate * 100", 1), F.lit("% | "),
            fixed("average_score", 2), F.lit(" | "),
            fixed("average_latency_sec", 2), F.lit("s |"),
        ).alias("line"),
    )
    spark = board.sparkSession
    head = spark.createDataFrame([(1, TITLE), (2, ""), (3, HEADER), (4, ALIGN)], "line_no long, line string")
    return head.unionByName(body)


def markdown_text(board: DataFrame) -> str:
    """The whole Markdown document (driver side; the board is one row per model × task file)."""
    if board.isEmpty():
        return f"{TITLE}\n\n{EMPTY}\n"
    lines = [r.line for r in markdown_rows(board).orderBy("line_no").collect()]
    return "\n".join(lines + [""])


def migrate_summary_frames(frames: list[DataFrame]) -> DataFrame:
    """Summary rows of any header generation in the current column set.

    Columns a generation lacks become NULL (blank), extra columns are
    dropped; nothing is rewritten in place (the caller writes the result to
    a new path if it wants to persist it). If all frames carry ``__seq`` it is
    kept, behind the frame's place in the list.
    """
    from evalgrid.operators.summary import SUMMARY_COLUMNS

    placed = all("__seq" in f.columns for f in frames)
    if placed:
        frames = [f.withColumn("__seq", F.struct(F.lit(i).alias("frame"), F.col("__seq").alias("seq"))) for i, f in enumerate(frames)]
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    for c in SUMMARY_COLUMNS:
        if c not in merged.columns:
            merged = merged.withColumn(c, F.lit(None).cast("string"))
    return merged.select(*SUMMARY_COLUMNS, *(["__seq"] if placed else []))
