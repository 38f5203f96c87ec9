"""Queries of the training-data operators, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import (
    digests, language_id, line_dedup, packing, prefix_trie, quality, resampling, sampling, sharding, simhash, token_files, toxicity,
)
from evalgrid.llm.common import prepare, shared_folder, table
from evalgrid.llm.tokens import default_tokenizer


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents over 3-word shingles, linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the isolation forest's verdict on all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def op3_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that three or more documents share; the largest doc_id keeps them."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least_chars=20, min_docs=3)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _op3_sql() -> str:
    strip = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, {strip}), {lower}) AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 2048 tokens without padding."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1, added=True)
    return pieces.drop("ids")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, row counts at most one apart."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole document, without replacement, decoded again."""
    drawn = sampling.sample_segmentations(table(spark, sf_dir, "documents"), sampling.default_model(), k=2)
    return drawn.drop("ids")


def op7_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts, compared."""
    out = digests.compare_neighbours(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.hex(c) for c in ("fingerprint", "edited_fingerprint")})


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents; labels of held-out rows are not learnt."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_classifier(docs, labels.where(~quality.held_out()))
    return _verdicts(quality.score_documents(docs, model), 0.3)


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents; labels of held-out rows are not learnt."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    detector = toxicity.fit_detector(docs, labels.where(~quality.held_out()))
    return _verdicts(toxicity.score_documents(docs, detector), 0.5)


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(quality.held_out(), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files in order of doc_id, and read back."""
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=0, added=True)
    return token_files.read_token_files(spark, path)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their gain towards the benchmark's words; the tenth with the highest scores is ranked."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    drawn = resampling.resample(docs, target, percent=10, least_words=20, max_n=1, buckets=10_000, seed="2024")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of the text ``{0}``: the register steps over its bytes by the table of ``_CRC_TABLE``.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS steps
)"""
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * octet_length(encode({0})), 2),
    lambda i: ('0x' || substr(hex(encode({0})), i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


def _op11_sql() -> str:
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
WITH {_CRC_TABLE}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), said AS (
  SELECT r, unnest(w) AS w FROM docs
), asked AS (
  SELECT unnest({words}) AS w FROM benchmark
), buckets AS (
  SELECT w, {_CRC.format("w")} % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM said UNION ALL SELECT w FROM asked)), crc_table
), corpus AS (
  SELECT bucket, count(*) AS s FROM said JOIN buckets USING (w) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM asked JOIN buckets USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + 10000)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM asked) + 10000))))::BIGINT AS gain
  FROM corpus LEFT JOIN target USING (bucket)
), weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM said JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r
), scores AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) FROM drawn) * 10 // 100 THEN rank END AS rank
FROM scores LEFT JOIN drawn USING (r)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun as the first of its five does, with subtree totals."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), family=5, heads=9)


def _op12_sql() -> str:
    return f"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id AS c, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || ':' || text)) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY place) AS said FROM turns GROUP BY c
), rebuilt AS (
  SELECT c, list_concat(coalesce(list_slice(base.said, 1, h), []), list_slice(own.said, h + 1, len(own.said))) AS said
  FROM (SELECT c, said, {_CRC.format("c::VARCHAR")} % 9 AS h FROM own, crc_table) AS own
  LEFT JOIN (SELECT c AS b, said FROM own) AS base ON b = c - c % 5
), held AS (
  SELECT c, said, unnest(range(len(said) + 1)) AS depth FROM rebuilt
), members AS (
  SELECT c, depth, said[1:depth] AS node, said[1:depth - 1] AS parent, depth = len(said) AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(said[depth].text)) END AS n_bytes
  FROM held
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, parent
), weighed AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children AS k ON n.depth = k.depth AND n.node = k.node
), under AS (
  SELECT above, node[1:above] AS top, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * n_bytes AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM weighed)
), totals AS (
  SELECT above, top, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY above, top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM weighed AS n JOIN totals ON above = n.depth AND top = n.node
LEFT JOIN nodes AS p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.parent
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; those with a remainder of 2 are not learnt."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict_languages(docs, language_id.fit_profiles(docs.where(~language_id.held_out())))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_simhash_near_dedup,
    op2_isolation_rules,
    op3_bloom_line_dedup,
    op4_hierarchical_packing,
    op5_feistel_sharding,
    op6_gumbel_segmentations,
    op7_improbable_digest,
    op8_boosted_quality,
    op9_lexicon_toxicity,
    op10_token_files,
    op11_importance_resampling,
    op12_conversation_trie,
    op13_language_id,
]


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _prepared(f) for f in _QUERIES}
ORACLES: dict[str, Callable[[], str]] = {
    "op3_bloom_line_dedup": _op3_sql,
    "op11_importance_resampling": _op11_sql,
    "op12_conversation_trie": _op12_sql,
}
