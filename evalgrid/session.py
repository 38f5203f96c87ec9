"""SparkSession helpers.

The library never creates a session behind the caller's back: every public
function takes DataFrames (or a session) as input. These helpers exist for
tests, the bench and the driver entry, and for two settings the library
relies on (duplicate JSON keys, the shared checkpoint folder).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every evalgrid job wants, whatever the cluster size.
LIBRARY_CONF = {
    # Python's json.loads keeps the last of duplicate keys; so does VARIANT
    # parsing when this is on (otherwise the whole value is rejected).
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "evalgrid") -> SparkSession:
    """A local session for tests and benchmarks (UI off, small shuffles)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        # checkpoints of row numbering are removed once their RDD is garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in LIBRARY_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_library_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the scorers depend on to an existing session."""
    for k, v in LIBRARY_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf on a managed cluster: keep theirs
            pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is respected as is; a
    cluster session without it is refused, as executors could not read the
    driver's folders. In local mode an unset one gets a scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return spark.sparkContext.getCheckpointDir() or current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="evalgrid-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for tables a job writes and re-reads."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "evalgrid", *parts])


def _one_machine(sc) -> bool:
    return sc.master.startswith("local") and not sc.master.startswith("local-cluster")


def spread(df):
    """In local mode, deal ``df`` to all cores; on a cluster ``df`` as it is.

    The given tables are single files with one row group each, which a local
    session would read, and score, in one task. On a cluster inputs have the
    splits they need, so no shuffle is added there; rows that cost far more
    than their bytes are dealt by ``deal``.
    """
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if _one_machine(sc) else df


#: Tasks that ``deal`` makes of a split of the input, and of a core, at least.
TASKS_A_SPLIT, TASKS_A_CORE = 8, 4


def deal(df, *keys: str):
    """On a cluster, deal the rows of an input by the hash of ``keys`` to more tasks than it has splits.

    For narrow rows that are costly to work on: a split of columnar files holds
    millions of them, and a file of one row group is read by one task however
    many cores wait. Name keys that few rows share. In local mode ``spread`` has done it.
    """
    sc = df.sparkSession.sparkContext
    if _one_machine(sc):
        return df
    return df.repartition(max(TASKS_A_CORE * sc.defaultParallelism, TASKS_A_SPLIT * df.rdd.getNumPartitions()), *keys)


def ship_package(spark: SparkSession) -> None:
    """Make ``evalgrid`` importable in executor Python workers (``mapInPandas``,
    pandas UDFs): zip the package once per session on the driver and
    ``addPyFile`` it, as ``--py-files`` would. Spark sends the file to the
    executors itself, so no storage is involved."""
    import zipfile

    import evalgrid

    sc = spark.sparkContext
    if getattr(sc, "_evalgrid_pyfile", None):
        return
    pkg_dir = os.path.dirname(os.path.abspath(evalgrid.__file__))
    root = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="evalgrid-py-"), "evalgrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._evalgrid_pyfile = target
