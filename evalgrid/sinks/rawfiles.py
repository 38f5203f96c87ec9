"""Result files under the names that users look for, and an index of what is whole in them.

``write_raw_files`` gives every run its file
``<root>/<model>/<task file stem>_<run id>.jsonl``. Spark writes the lines of
a file in one task into a staging folder through its commit protocol; once the
job is whole, the driver renames the files, metadata only. ``raw_line_index``
reads such files back with the byte offset of each line, so that a run that
was cut off in the middle of a line goes on where its last whole line ends.
Both work on any store that Spark reads and writes.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrid.functions.jsonv import json_kind_sql, with_strict_json
from evalgrid.sinks.files import file_stem

FILE_KEYS = ("model_config_id", "task_file", "run_id")


def _file_name() -> Column:
    """``<model>/<stem>_<run id>``; a null key reads as an empty text."""
    known = [F.coalesce(c, F.lit("")) for c in (F.col("model_config_id"), file_stem("task_file"), F.col("run_id"))]
    return F.concat(known[0], F.lit("/"), known[1], F.lit("_"), known[2])


def write_raw_files(
    attempts: DataFrame, root: str, order: Sequence[str] = ("task_id", "repeat_index"), runs: DataFrame | None = None,
    line: str | None = None, rows_per_file: int = 2_000_000,
) -> None:
    """Attempts as JSON lines, a file per run in ``order``, replacing a file of that name.

    A line is the attempt as a JSON object with its nulls, or the text column
    ``line``. Runs whose names are the same (task files that differ in their
    folder alone) share a file. A run of more than ``rows_per_file`` rows goes
    on in ``<name>.2.jsonl``, ``<name>.3.jsonl``..., each dealt by the hash of
    ``order``, so no task writes more. Runs of ``runs`` (model_config_id,
    task_file, run_id) without attempts get empty files. A name that leaves
    ``root`` is refused before anything is written. If the job fails, the
    files that were there stay as they were.
    """
    spark = attempts.sparkSession
    text = F.col(line) if line else F.to_json(F.struct(*attempts.columns), {"ignoreNullFields": "false"})
    rows = attempts.select(_file_name().alias("__name"), text.alias("__line"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    files = rows.groupBy("__name").agg(F.count(F.lit(1)).alias("__n"))
    if runs is not None:
        planned = runs.select(_file_name().alias("__name"), F.lit(0).cast("bigint").alias("__n"))
        files = files.unionByName(planned).groupBy("__name").agg(F.max("__n").alias("__n"))
    files = files.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(rows_per_file)))).drop("__n")
    places = [f"__o{i}" for i in range(len(order))]
    part = F.pmod(F.xxhash64(*places), F.col("__parts")) if places else F.lit(0)
    parted = rows.join(files, "__name").withColumn("__part", part.cast("int"))
    parted = parted.withColumn("__file", F.xxhash64("__name", "__part"))

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    targets = {}
    names = files.select("__name", F.explode(F.sequence(F.lit(0), (F.col("__parts") - 1).cast("int"))).alias("part"))
    for r in names.withColumn("file", F.xxhash64("__name", "part")).toLocalIterator():
        name = posixpath.normpath(f"{r['__name']}.jsonl" if r.part == 0 else f"{r['__name']}.{r.part + 1}.jsonl")
        if name.startswith(("../", "/")) or r.file in targets:
            raise ValueError(f"no file of its own under the root: {name!r}")
        targets[r.file] = (name, r.part)
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    lines = parted.repartition("__file").sortWithinPartitions("__file", *places).select("__file", F.col("__line").alias("value"))
    try:
        lines.write.option("maxRecordsPerFile", 0).partitionBy("__file").text(staging)
        written = {}
        found = fs.listFiles(path(staging), True)
        while found.hasNext():
            p = found.next().getPath()
            if p.getParent().getName().startswith("__file="):
                written[int(p.getParent().getName().split("=", 1)[1])] = p
        folders = {posixpath.dirname(name) for name, _ in targets.values()}
        there = {f: fs.exists(path(f"{root.rstrip('/')}/{f}")) for f in folders}
        for f in folders:
            if not there[f]:
                fs.mkdirs(path(f"{root.rstrip('/')}/{f}"))
        for file, (name, n) in targets.items():
            target = path(f"{root.rstrip('/')}/{name}")
            if file not in written and n:
                continue
            if there[posixpath.dirname(name)]:
                fs.delete(target, False)
            if file not in written:
                fs.create(target).close()
            elif not fs.rename(written[file], target):
                raise OSError(f"could not move {written[file]} to {target}")
    finally:
        fs.delete(path(staging), True)


def raw_line_index(spark: SparkSession, root: str) -> DataFrame:
    """Every line of the ``.jsonl`` files under ``root``: file, line_no, byte_offset, byte_length, end_offset, ok, line.

    ``file`` is the path below ``root``. Lines end at ``\\n``; ``end_offset`` is
    the place after it, or the file's end. ``ok``: the line is one whole JSON
    object. Offsets add up within each split of a file, and a table with one
    row per split gives what lies before it, so no task holds a whole file.
    Empty files have no line.
    """
    scan = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    lines = scan.select(
        F.col("_metadata.file_path").alias("__uri"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.col("_metadata.file_size").alias("__size"),
        F.monotonically_increasing_id().alias("__pos"),
        F.octet_length("value").cast("bigint").alias("byte_length"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("__uri", "__split").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("byte_length") + 1).alias("__b"))
    before = Window.partitionBy("__uri").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__uri", "__split", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__b")))
    here = Window.partitionBy("__uri", "__split").orderBy("__pos")
    placed = lines.withColumns({
        "__line": F.row_number().over(here),
        "__end": F.sum(F.col("byte_length") + 1).over(here.rowsBetween(Window.unboundedPreceding, 0)),
    }).join(splits, ["__uri", "__split"])
    checked = with_strict_json(placed, "line", "__json")
    end = F.col("__b_before") + F.col("__end")
    base = root.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    return checked.select(
        F.expr("try_url_decode(replace(__uri, '+', '%2B'))").alias("__path"), "__uri", "byte_length", "line",
        (F.col("__n_before") + F.col("__line")).alias("line_no"),
        (end - F.col("byte_length") - 1).alias("byte_offset"),
        F.least(end, F.col("__size")).alias("end_offset"),
        F.coalesce(F.expr(f"{json_kind_sql('__json')} = 'dict'"), F.lit(False)).alias("ok"),
    ).select(
        F.expr(f"substr(__path, locate('/{base}/', __path) + {len(base) + 2})").alias("file"),
        "line_no", "byte_offset", "byte_length", "end_offset", "ok", "line",
    )


def raw_file_report(index: DataFrame) -> DataFrame:
    """Per file of a line index: lines, corrupt_lines, completed_attempts, size_bytes, good_bytes, torn.

    ``good_bytes`` is where the last whole line ends (0 if none is): a run
    that resumes cuts the file there and goes on. ``torn``: something lies
    beyond."""
    good = F.coalesce(F.max(F.when(F.col("ok"), F.col("end_offset"))), F.lit(0)).cast("bigint")
    report = index.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("ok")).alias("corrupt_lines"),
        F.count_if("ok").alias("completed_attempts"),
        F.max("end_offset").cast("bigint").alias("size_bytes"),
        good.alias("good_bytes"),
    )
    return report.withColumn("torn", F.col("good_bytes") < F.col("size_bytes"))
