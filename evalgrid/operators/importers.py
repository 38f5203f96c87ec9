"""Benchmark importers: source rows -> task rows that pass the loader's checks.

Each importer is a projection over its source table (no Python): the
answer of a GSM8K-style row is the text after ``####``; a multiple-choice
row gets lettered choices in its description and the answer letter as the
expected output; a code-style row becomes a keyword task. Source
attribution goes into ``metadata``. ``limit`` (optional) keeps the first
rows by source id, a feature of the importer, not a sampling shortcut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: GSM8K answer marker.
GSM8K_MARK = "####"


def _limit(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    return df.orderBy(order).limit(limit) if limit is not None else df


def import_gsm8k(src: DataFrame, id_col: str = "src_id", question: str = "question", answer: str = "answer",
                 limit: int | None = None) -> DataFrame:
    out = src.select(
        F.concat(F.lit("gsm8k-"), F.col(id_col).cast("string")).alias("id"),
        F.col(question).alias("description"),
        F.trim(F.regexp_extract(F.col(answer), GSM8K_MARK + r"\s*(.*)$", 1)).alias("expected_output"),
        F.lit("math").alias("category"),
        F.lit("gsm8k").alias("source"),
        F.col(id_col).alias("src_id"),
        F.lit(None).cast("array<string>").alias("keywords"),
    )
    return _limit(out, "src_id", limit)


def import_multiple_choice(src: DataFrame, id_col: str = "src_id", question: str = "question", choices: str = "choices",
                           answer_index: str = "answer_index", limit: int | None = None) -> DataFrame:
    """Choices become ``A. ...`` lines after the question; the answer is its letter."""
    lettered = F.transform(F.col(choices), lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c))
    out = src.select(
        F.concat(F.lit("mmlu-"), F.col(id_col).cast("string")).alias("id"),
        F.concat_ws("\n", F.col(question), F.array_join(lettered, "\n")).alias("description"),
        F.char(F.lit(65) + F.col(answer_index)).alias("expected_output"),
        F.lit("text").alias("category"),
        F.lit("mmlu").alias("source"),
        F.col(id_col).alias("src_id"),
        F.lit(None).cast("array<string>").alias("keywords"),
    )
    return _limit(out, "src_id", limit)


def import_code(src: DataFrame, id_col: str = "src_id", prompt: str = "prompt", entry_point: str = "entry_point",
                limit: int | None = None) -> DataFrame:
    """A code-style row is scored by keywords: the entry point and ``return``."""
    out = src.select(
        F.concat(F.lit("humaneval-"), F.col(id_col).cast("string")).alias("id"),
        F.col(prompt).alias("description"),
        F.col(entry_point).alias("expected_output"),
        F.lit("code").alias("category"),
        F.lit("humaneval").alias("source"),
        F.col(id_col).alias("src_id"),
        F.array(F.col(entry_point), F.lit("return")).alias("keywords"),
    )
    return _limit(out, "src_id", limit)


def as_task_lines(tasks: DataFrame, task_file: str = "imported.jsonl") -> DataFrame:
    """Imported tasks as JSONL lines (id, description, expected_output, metadata) for the loader."""
    meta = F.struct(F.col("category").alias("category"), F.col("source").alias("source"), F.col("src_id").alias("source_id"),
                    F.col("keywords").alias("keywords"))
    line = F.to_json(F.struct("id", "description", "expected_output", meta.alias("metadata")))
    return tasks.select(F.lit(task_file).alias("task_file"), F.col("src_id").alias("line_no"), line.alias("line"), "source")
