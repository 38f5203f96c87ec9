"""Document quality: a boosted-tree classifier, and rules with an isolation forest.

Both see only rates of whole-text statistics (``stats.features``), are fitted
on all labelled rows, and score every row in one pass over the texts without a
shuffle. Sums over the rows are exact, so a model does not depend on the order
of the input.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm import forests
from evalgrid.llm.common import checkpointed, kept_in_worker
from evalgrid.llm.stats import FEATURES, NAMES, batch_statistics, features, statistics


def held_out(key: str = "doc_id", parts: int = 5) -> Column:
    """True for rows whose labels are not learnt: crc32 of the key's text leaves 0 modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts == 0


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__key``, statistics (``NAMES``) and ``__label`` of every labelled document, materialised.

    Equal keys count once, null keys and labels do not count. Counts meet the
    labels, not texts: no text is shuffled.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return checkpointed(statistics(texts, "__key", "__text").join(known, "__key").dropDuplicates(["__key"]))


#: Rows of a block of binned features, and blocks whose margins a worker keeps.
BLOCK_ROWS, KEPT_BLOCKS = 100_000, 32


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of ``NAMES`` of a batch of ``labelled_statistics``."""
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES])


def _cuts(known: DataFrame) -> list[np.ndarray]:
    """Cuts of each feature by the values of all rows, counted after they are rounded to eight binary digits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in FEATURES]
        for batch in batches:
            mantissa, power = np.frexp(features(_rows(batch)))
            rounded = np.ldexp(np.rint(mantissa * 256) / 256, power)
            for counts, column in zip(held, rounded.T):
                counts.update(dict(zip(*(c.tolist() for c in np.unique(column, return_counts=True)))))
        for f, counts in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(counts), pa.int64()), pa.array(counts.keys(), pa.float64()), pa.array(counts.values(), pa.int64())],
                names=["feature", "value", "n"],
            )

    rows = known.select(*NAMES).coalesce(known.sparkSession.sparkContext.defaultParallelism)
    counted = rows.mapInArrow(task, "feature long, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    feature, values, n = (np.asarray(c) for c in counted.orderBy("feature", "value").toArrow().columns)
    return [forests.quantile_cuts(values[feature == f], n[feature == f]) for f in range(len(FEATURES))]


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", **options) -> forests.Boosted:
    """Histogram gradient-boosted trees over the statistics of all labelled documents.

    Give only rows of ``labels`` that may be learnt. Without labelled rows of
    both kinds every document gets the same score. Blocks of binned features
    stay on the executors; each level of a tree is one job that sums their
    histograms. Labels other than 0 count as 1. ``options`` are those of ``forests.grow_boosted``.
    """
    known = labelled_statistics(docs, labels, label, key, text).withColumn("__label", (F.col("__label") != 0).cast("int"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("__label"), F.lit(0))).first()
    share = (ones + 0.5) / (n + 1)
    if ones in (0, n):
        return forests.constant(share)
    cuts, fit = _cuts(known), uuid.uuid4().hex

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(forests.binned(features(_rows(b)), cuts), np.asarray(b.column("__label"), np.uint8)) for b in batches]
        if read:
            bins, y = (np.concatenate(c, axis=-1) for c in zip(*read))
            yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes()]), pa.array([y.tobytes()])], names=["bins", "y"])

    parts = -(-n // BLOCK_ROWS)
    blocks = known.drop("__key").repartition(parts).mapInArrow(block, "bins binary, y binary")
    blocks = checkpointed(blocks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def histograms(splits: forests.Splits, tree: int, level: int) -> np.ndarray:
        def task(part: int, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
            kept = kept_in_worker(("margins", fit), dict)
            for raw, labels_ in rows:
                y = np.frombuffer(labels_, np.uint8)
                bins = np.frombuffer(raw, np.uint8).reshape(-1, len(y))
                done, margin = kept.pop(part, (0, None))
                if done > tree:
                    done, margin = 0, None
                margin = splits.advanced(bins, margin, done, tree)
                if len(kept) >= KEPT_BLOCKS:
                    kept.pop(next(iter(kept)))
                kept[part] = tree, margin
                yield splits.histograms(bins, y, margin, tree, level).tobytes()

        shape = (2, 1 << level, len(FEATURES), forests.BINS)
        return sum(np.frombuffer(b).reshape(shape) for b in blocks.mapPartitionsWithIndex(task).collect())

    try:
        return forests.grow_boosted(cuts, share, histograms, **options)
    finally:
        blocks.unpersist()


def _scores(model: forests.Boosted, texts: pa.Array) -> np.ndarray:
    return model.predict(features(batch_statistics(texts)))


def score_documents(docs: DataFrame, model: forests.Boosted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` (probability of label 1) of every row; a null text is empty, other columns are not read."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(task, f"{key} long, score double")


def filtered(docs: DataFrame, verdict: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text ``verdict`` accepts; batches of texts stay in Arrow."""
    at = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def keep_good(docs: DataFrame, model: forests.Boosted, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    return filtered(docs, lambda texts: _scores(model, texts) >= threshold, text)


# -- rules -------------------------------------------------------------------

#: Rates that the isolation forest sees, as they are.
RULES = ("symbols", "pipes", "bangs", "upper", "repeats", "neighbours", "dup_lines", "word_length", "longest", "digits", "distinct")
#: Base rules: fewer words, or more per cent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30


def rule_rates(stats: np.ndarray) -> np.ndarray:
    """The watched rates of rows of ``NAMES``: the isolation forest's features."""
    return features(stats)[:, [FEATURES.index(r) for r in RULES]]


def base_failed(stats: np.ndarray) -> np.ndarray:
    s = np.asarray(stats).reshape(-1, len(NAMES))
    words, repeats = s[:, NAMES.index("n_words")], s[:, NAMES.index("n_repeat_words")]
    return (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)


@dataclass
class Rules:
    forest: forests.Isolation
    threshold: float

    def anomaly(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.score(rule_rates(stats))


#: Trees of the forest, and the rows that each is grown on.
TREES, TREE_ROWS = 200, 256


def _drawn(known: DataFrame) -> np.ndarray:
    """Statistics of rows drawn from all of ``known`` by the hash of the key, as many as the trees together take (all if there are fewer)."""
    n, wanted = known.count(), TREES * TREE_ROWS
    share = min(1.0, 1.1 * wanted / max(n, 1))
    order = F.xxhash64("__key")
    rows = known.where(order <= int(share * (2**63 - 1) - (1 - share) * 2**63)) if share < 1 else known
    got = rows.select(order.alias("__order"), *NAMES).toArrow()
    x = np.column_stack([np.asarray(c, np.int64) for c in got.columns])
    return x[np.lexsort(x.T[::-1])][:wanted, 1:]


def _leaf_counts(known: DataFrame, forest: forests.Isolation) -> np.ndarray:
    """How many rows of ``known`` come to each leaf of each tree; one table of counts for each core."""
    shape = forest.level.shape
    first = np.arange(shape[0]) * shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            at = forest.trees.places(rule_rates(_rows(batch))) + first
            counts += np.bincount(at.ravel(), minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["leaf", "n"])

    counts = np.zeros(shape[0] * shape[1], np.int64)
    rows = known.select(*NAMES).coalesce(known.sparkSession.sparkContext.defaultParallelism)
    met = rows.mapInArrow(task, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(met.column("leaf"), np.int64)] = np.asarray(met.column("n"), np.int64)
    return counts.reshape(shape)


def calibrate(scored: DataFrame, weight: float = 3.0) -> float:
    """Anomaly score from which rows are rejected: most accepted good rows (times ``weight``) plus rejected bad rows.

    ``scored``: ``anomaly`` and ``label`` of each row. Halfway between the
    scores it separates; infinite (nothing is rejected) without bad rows. The
    scores are counted in ranges, of which the driver sees only the totals.
    """
    counts = [F.count_if(F.col("label") == y).alias(n) for y, n in ((1, "good"), (0, "bad"))]
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = scored.groupBy("anomaly").agg(*counts).repartitionByRange(parts, "anomaly")
    marks = checkpointed(marks.withColumn("range", F.spark_partition_id()))
    totals = marks.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("anomaly").alias("last"))
    before, good, bad, last = [], 0, 0, None
    for r in totals.orderBy("range").collect():
        before.append((r["range"], good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r["last"]
    if not bad:
        return float("inf")
    earlier = F.broadcast(spark.createDataFrame(before, "range int, good_before long, bad_before long, last double"))
    within = Window.partitionBy("range").orderBy("anomaly")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    good_below, bad_below = (F.coalesce(F.sum(n).over(upto), F.lit(0)) + F.col(f"{n}_before") for n in ("good", "bad"))
    value = weight * (good_below / max(good, 1)) + (1 - bad_below / bad)
    below = F.coalesce(F.lag("anomaly").over(within), "last", F.col("anomaly") - 1e-9)
    found = marks.join(earlier, "range").select(value.alias("value"), (-F.col("anomaly")).alias("first"), below.alias("below"))
    best = found.agg(F.max(F.struct("value", "first", "below")).alias("best")).first().best
    return float((best.below - best.first) / 2)


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Rules:
    """Isolation forest over rule statistics of all labelled documents.

    Each tree is grown on rows drawn from all of them, and path lengths are by
    the counts of all of them in the leaves. The forest does not see the
    labels; the threshold is calibrated by them, on all rows that pass the
    base rules.
    """
    known = labelled_statistics(docs, labels, label, key, text)
    forest = forests.fit_isolation(rule_rates(_drawn(known)), TREES, TREE_ROWS)
    forest = forest.recounted(_leaf_counts(known, forest))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _rows(batch)
            rest = ~base_failed(s)
            scores = forest.score(rule_rates(s[rest]))
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column("__label").filter(pa.array(rest))], names=["anomaly", "label"])

    return Rules(forest, calibrate(known.drop("__key").mapInArrow(task, "anomaly double, label int")))


RULE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, rules: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` and ``kept`` of every row.

    A null or empty text has no words, so it fails the base rules. Null keys
    and repeated rows are judged like any other; other columns are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch_statistics(batch.column(1))
            failed, anomaly = base_failed(s), rules.anomaly(s)
            kept = ~failed & (anomaly < rules.threshold)
            counts = [pa.array(s[:, NAMES.index(n)]) for n in RULE_COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(anomaly), pa.array(kept)],
                names=[key, *RULE_COUNTS, "base_failed", "anomaly", "kept"],
            )

    schema = f"{key} long, " + ", ".join(f"{n} long" for n in RULE_COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select(key, text).mapInArrow(task, schema)
