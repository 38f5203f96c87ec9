"""Streaming ingest of attempts with a running run summary.

Raw attempts arrive as JSON-lines files (one or more per run, written as
attempts finish). The stream:

1. reads new files (``maxFilesPerTrigger`` bounds a micro-batch);
2. drops re-delivered attempts with ``dropDuplicatesWithinWatermark`` on the
   attempt key. The watermark is on ingest time, so this state, the only one,
   is bounded by ``dedupe_delay``; a retry that arrives later is written again,
   and ``stored_attempts`` drops it;
3. ``foreachBatch`` writes each micro-batch's attempts whole to a parquet table,
   and beside it their counts and sums per task, both partitioned by
   ``batch_id`` (overwriting only that partition, so a replayed batch after a
   failure is idempotent).

The current summary adds up the per-task partials of all batches;
``compact_partials`` folds them into one row per task. Offsets and state live in
the checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators.summary import RUN_KEYS, finish_summary, sum_again, sum_parts

ATTEMPT_STREAM_SCHEMA = (
    "event_id bigint, model_config_id string, task_file string, task_id string, repeat_index int, "
    "score double, passed boolean, latency_sec double, run_id string, "
    "category string, prompt string, expected string, response string, reason string, repeat_count int, "
    "settings struct<context_size: int, temperature: double, top_p: double, max_tokens: int>"
)
TASK_KEYS = [*RUN_KEYS, "task_id"]
ATTEMPT_KEY = [*TASK_KEYS, "repeat_index"]


def attempt_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 8,
                   schema: str = ATTEMPT_STREAM_SCHEMA) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(source_dir)
    )


def deduplicated(stream: DataFrame, dedupe_delay: str = "10 minutes") -> DataFrame:
    """The stream without attempts that are delivered again within ``dedupe_delay``."""
    marked = stream.withColumn("ingest_ts", F.current_timestamp()).withWatermark("ingest_ts", dedupe_delay)
    return marked.dropDuplicatesWithinWatermark(ATTEMPT_KEY)


def task_partials(attempts: DataFrame) -> DataFrame:
    """Counts and sums per task that add up over batches."""
    return attempts.groupBy(*TASK_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("passed")).alias("p"),
        *sum_parts("score", "s"),
        *sum_parts("latency_sec", "l"),
    )


def _folded(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*TASK_KEYS).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), *sum_again("s"), *sum_again("l")
    )


def start_running_summary(spark: SparkSession, source_dir: str, updates_dir: str, checkpoint_dir: str,
                          available_now: bool = True, max_files_per_trigger: int = 8):
    """Start the stream into ``updates_dir`` (tables ``attempts`` and ``partials``); returns the StreamingQuery."""
    stream = deduplicated(attempt_stream(spark, source_dir, max_files_per_trigger))

    def write(rows: DataFrame, name: str, batch_id: int) -> None:
        (
            rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(f"{updates_dir}/{name}")
        )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(batch, "attempts", batch_id)
            write(task_partials(batch), "partials", batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stored_attempts(spark: SparkSession, updates_dir: str) -> DataFrame:
    """Every attempt of the stream once, whole, as of the last committed micro-batch."""
    rows = spark.read.parquet(f"{updates_dir}/attempts")
    first = rows.groupBy(*ATTEMPT_KEY).agg(F.min_by(F.struct(*rows.columns), "batch_id").alias("a"))
    return first.select("a.*")


def compact_partials(spark: SparkSession, updates_dir: str, compacted_dir: str) -> None:
    """Write the partials of all batches, one row per task, to a new folder that ``current_summary`` can read."""
    _folded(spark.read.parquet(f"{updates_dir}/partials")).write.parquet(f"{compacted_dir}/partials")


def current_summary(spark: SparkSession, updates_dir: str) -> DataFrame:
    """The running summary as of the last committed micro-batch."""
    per_run = _folded(spark.read.parquet(f"{updates_dir}/partials")).groupBy(*RUN_KEYS).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.sum("n").alias("total_attempts"),
        F.sum("p").alias("passed"),
        *sum_again("__s", "s"),
        *sum_again("__l", "l"),
        F.max("n").alias("repeats"),
    )
    return finish_summary(per_run)
