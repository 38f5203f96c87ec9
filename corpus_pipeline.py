"""The corpus pipeline: documents to packed training sequences.

Each stage calls one operator of ``evalgrid.llm`` on all that the stage before
kept; all but the last return the columns of ``documents``. Between stages the
rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import line_dedup, packing, quality, simhash, toxicity
from evalgrid.llm.common import prepare, shared_folder, table
from evalgrid.llm.tokens import default_tokenizer


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~quality.held_out())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score at 0.3 or more."""
    prepare(spark)
    return quality.keep_good(docs, quality.fit_classifier(docs, _learnable(spark, sf_dir)), 0.3)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's model scores below 0.5.

    The model is fitted on the whole table, not on what is left of it: which
    words are ordinary ones shows best where all documents are.
    """
    prepare(spark)
    detector = toxicity.fit_detector(table(spark, sf_dir, "documents"), _learnable(spark, sf_dir))
    return toxicity.keep_clean(docs, detector, 0.5)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share; ``n_chars`` follows the text."""
    prepare(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = line_dedup.dedup_lines(docs, least_chars=20, min_docs=3, carry=rest)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(own[c] if c in own else F.col("carried")[c] for c in docs.columns)).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=3, max_distance=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    prepare(spark)
    return packing.pack_documents(docs, default_tokenizer(), end_id=1, added=True).drop("ids")


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("packing", packed),
]

#: Trained models and tokenization have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
