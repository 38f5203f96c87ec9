"""File sinks: raw attempts (JSONL), summaries (CSV or parquet), the Markdown report.

All writes go through Spark's commit protocol (a job's files appear
atomically, a failed task's output is discarded), partitioned by model and
run so readers prune to what they need. Nothing is rewritten in place: a
summary with a changed schema is migrated into a new path.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrid.operators.summary import SUMMARY_COLUMNS

_LOG = logging.getLogger(__name__)

# Fixed value: file stem of a task path (last component without its extension).
STEM_RE = r"([^/\\]+?)(\.[^./\\]*)?$"


def file_stem(col: str) -> Column:
    return F.regexp_extract(F.col(col), STEM_RE, 1)


def raw_results_path(model: str, task_file: str, run_id: str) -> Column:
    """``results/raw/<model>/<task file stem>_<run_id>.jsonl`` for each row."""
    return F.concat(F.lit("results/raw/"), F.col(model), F.lit("/"), file_stem(task_file), F.lit("_"), F.col(run_id), F.lit(".jsonl"))


def write_raw_attempts(attempts: DataFrame, path: str, mode: str = "append") -> None:
    """Attempts as JSON lines under ``path/model_config_id=.../run_id=...``; nulls kept as null.

    ``rebalance`` (not ``repartition``) on the partition columns: AQE splits a
    (model, run) pair that holds most of the rows over several writer tasks
    and merges small ones, so a hot run neither lands in one task nor
    produces thousands of tiny files."""
    (
        attempts.hint("rebalance", "model_config_id", "run_id")
        .write.mode(mode)
        .option("ignoreNullFields", "false")
        .partitionBy("model_config_id", "run_id")
        .json(path)
    )


def write_summary(summary: DataFrame, path: str, fmt: str = "csv", mode: str = "append") -> None:
    """Append summary rows; CSV is written with a header in every part file."""
    w = summary.select(*SUMMARY_COLUMNS).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_summary_csv(spark, path: str) -> DataFrame:
    """All-string summary rows (any header generation); blank cells are NULL.

    ``__seq`` is the row's place: file, block of the file, position in it. The
    leaderboard keeps the first of two rows with the same run id, as a reader
    walking the files by name would. A missing path is an empty summary."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        _LOG.warning("no summary at %s", path)
        rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in SUMMARY_COLUMNS))
        return rows.withColumn("__seq", F.lit(None).cast("struct<file:string,block:bigint,row:bigint>"))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("*", place.alias("__seq"))


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write (line_no, line) rows as one text file in line order.

    The report has one row per model and task file plus four header lines,
    so a single output file is small by construction.
    """
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """Write the Markdown leaderboard; an empty board gives the title and ``No data yet.``."""
    from evalgrid.operators import leaderboard as lb

    spark = board.sparkSession
    if board.isEmpty():
        _LOG.warning("leaderboard input is empty; writing an empty report to %s", path)
        lines = spark.createDataFrame([(1, lb.TITLE), (2, ""), (3, lb.EMPTY)], "line_no long, line string")
    else:
        lines = lb.markdown_rows(board)
    write_markdown(lines, path)


def persist_run(attempts: DataFrame, summary: DataFrame, board: DataFrame, root: str) -> dict[str, str]:
    """Write raw attempts, the summary and the leaderboard under ``root``.

    Every sink is attempted even if an earlier one fails; the result maps
    each sink to ``"ok"`` or its error text.
    """
    steps = {
        "raw": lambda: write_raw_attempts(attempts, f"{root}/raw"),
        "summary": lambda: write_summary(summary, f"{root}/summary"),
        "leaderboard": lambda: write_leaderboard(board, f"{root}/reports/leaderboard"),
    }
    status: dict[str, str] = {}
    for name, step in steps.items():
        try:
            step()
            status[name] = "ok"
        except Exception as e:  # noqa: BLE001 - reported per sink
            status[name] = f"error: {type(e).__name__}: {e}"
    return status
