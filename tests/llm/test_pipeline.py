"""The pipeline against the brute-force versions of its operators."""

import zlib

import corpus_pipeline
from test_line_dedup import brute as brute_lines
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from evalgrid.llm import quality, stats, toxicity
from evalgrid.llm.tokens import default_tokenizer

BASE = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    labels = spark.read.parquet(f"{BASE}/labels.parquet").where(~quality.held_out())
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit_classifier(docs, labels)
    kept = {d: r.text for d, r in rows.items() if model.predict(stats.features([stats.text_statistics(r.text)]))[0] >= 0.3}
    detector = toxicity.fit_detector(docs, labels)
    kept = {d: t for d, t in kept.items() if toxicity.toxicity(detector, [t])[0] < 0.5}
    kept = {d: t for d, t, *_ in brute_lines(sorted(kept.items()), 20, 3)}
    ids = sorted(kept)
    roots = brute_components([brute_fingerprint(kept[d], 3) for d in ids], 2)
    kept = {ids[i]: kept[ids[i]] for i in set(roots)}
    assert 0 < len(kept) < len(rows)

    pieces: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, BASE).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == kept.keys()
    plain = Tokenizer.from_file(default_tokenizer())
    for d, own in pieces.items():
        want = plain.encode(kept[d], add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = want[r.start : r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.doc_tokens == len(want)
            at += r.length
        assert at == len(want)


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0)], docs.schema)
    for rows in (docs.limit(20).unionByName(odd), docs.where("false")):
        extra = rows.selectExpr("*", "'x' AS score", "1 AS n_lines", "'y' AS lost")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, extra, BASE).columns == extra.columns
            stage(spark, extra, BASE).collect()
        corpus_pipeline.STAGES[-1][1](spark, extra, BASE).collect()
