import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalgrid.llm import forests, quality, stats
SF_ORACLE = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, score string, kept string, n_words string"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in again for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


def texts():
    rng = np.random.default_rng(3)
    out = [None, "", " ", "\n\n", "one", "a b c d e f g h a b c d e f g h", "x " * 9, "a\x0bb\x1cc d é€😀 #*|<>\n é€😀", "l\nl\n l\nl\n\t\nl"]
    out += [" ".join(rng.choice(["ab", "c", "é"], n)) + sep * 2 for n in (7, 8, 9, 30, 200) for sep in ("\n", " ")]
    return out + ["word " * 20000]


def test_counts_match_brute_force():
    for t in texts()[:-1]:
        assert stats.text_statistics(t)[:5] == brute_counts(t), t
    assert stats.text_statistics(texts()[-1])[:5] == (20000, 80000, 0, 0, 20000)


def test_tree_walk_matches_a_loop():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 5)), rng.integers(0, 2, 400)
    model = forests.fit_boosted(x, y, rounds=7, depth=3)
    t = model.trees
    for row, got in zip(x[:50], model.predict(x[:50])):
        total = model.base
        for k in range(len(t.feature)):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[t.feature[k, node]] > t.threshold[k, node])
            total += t.leaf[k, node - 7]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_degenerate_fits():
    assert forests.fit_boosted(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).shape == (2,)
    assert (forests.fit_boosted(np.ones((5, 3)), np.ones(5)).predict(np.zeros((2, 3))) > 0.5).all()
    for n in (0, 1, 2, 5):
        score = forests.fit_isolation(np.ones((n, 3)), trees=3).score(np.zeros((2, 3)))
        assert ((score > 0) & (score <= 1)).all()


def test_isolated_rows_score_higher():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(500, 2)), [[9, 9]]])
    score = forests.fit_isolation(x, trees=50).score(x)
    assert score[-1] > np.quantile(score[:-1], 0.99)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), spark.read.parquet(f"{SF_ORACLE}/labels.parquet")


def test_classifier_on_held_out_rows(spark, docs):
    df, labels = docs
    model = quality.fit_classifier(df, labels.where(~quality.held_out()))
    rows = quality.score_documents(df, model).join(labels, "doc_id").where(quality.held_out()).collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(right) > 30 and np.mean(right) > 0.95
    kept = {r.doc_id for r in quality.keep_good(df, model).collect()}
    assert kept == {r.doc_id for r in quality.score_documents(df, model).where("score >= 0.3").collect()}


def test_rules_match_brute_counts_and_labels(spark, docs):
    df, labels = docs
    rules = quality.fit_rules(df, labels)
    got = {r.doc_id: r for r in quality.apply_rules(df, rules).join(labels, "doc_id", "left").collect()}
    for r in df.limit(60).collect():
        g = got[r.doc_id]
        n, *_, again = brute_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute_counts(r.text)
        assert g.base_failed == (n < 20 or 100 * again > 30 * n) and not (g.base_failed and g.kept)
    good = [r.kept for r in got.values() if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in got.values() if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_forest_sees_rates_below_any_cut():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(3, 9, 300)]
    good = [" ".join(rng.choice(words, 120)) for _ in range(300)]
    shouting = " ".join(w.upper() if i % 5 == 0 else w + "!" if i % 6 == 0 else w + "#" if i % 12 == 1 else w for i, w in enumerate(good[0].split()))
    long_words, short_words = " ".join("abcdefgh" * 6 + str(i) for i in range(60)), " ".join("abcdefgh"[i % 8] for i in range(60))
    x = np.array([stats.text_statistics(t) for t in [*good, shouting, long_words, short_words]])
    assert not quality.base_failed(x[[0, 300, 301]]).any()
    score = quality.Rules(forests.fit_isolation(quality.rule_rates(x)), 0.5).anomaly(x)
    assert len(np.unique(score[:300])) > 100 and (score[300:] > score[:300].max()).all()


def test_odd_rows(spark, docs):
    df, labels = docs
    odd = spark.createDataFrame([(None, None, "s", None, None), (1, "", None, "k", "n"), (1, "", None, "k", "n"), (2, "word " * 50000, "", "", "")], SCHEMA)
    model = quality.fit_classifier(odd, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in quality.score_documents(odd, model).collect())
    assert quality.keep_good(odd, model).columns == odd.columns
    got = quality.apply_rules(odd, quality.fit_rules(odd, labels.where("false"))).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    none = odd.where(F.lit(False))
    assert quality.score_documents(none, model).collect() == quality.keep_good(none, model).collect() == []


def test_all_labelled_rows_count(spark):
    n, bad = 22_000, 60
    rows = spark.range(n).withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("id"))))
    plain = F.concat_ws(" ", *(F.concat(F.lit("w"), ((F.col("id") + 1) * k % 10007).cast("string")) for k in range(1, 30)))
    text = F.when(F.col("at") > n - bad, F.regexp_replace(plain, "w", "#!| AB")).otherwise(plain)
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text")).cache()
    labels = rows.select(F.col("id").alias("doc_id"), (F.col("at") <= n - bad).cast("int").alias("quality")).cache()
    rules = quality.fit_rules(docs, labels)  # the bad rows have the largest hashes of all
    assert np.isfinite(rules.threshold) and rules.forest.scale == pytest.approx(float(forests._path(n)))
    assert quality.calibrate(spark.createDataFrame([(0.1, 1), (0.2, 1), (0.6, 0), (0.6, 0)], "anomaly double, label int")) == pytest.approx(0.4)
    counts = quality._leaf_counts(quality.labelled_statistics(docs, labels, "quality"), rules.forest)
    assert (counts.sum(axis=1) == n).all()
    model = quality.fit_classifier(docs, labels, rounds=6)
    got = quality.score_documents(docs, model).join(labels, "doc_id").groupBy("quality").agg(F.min("score"), F.max("score")).collect()
    low, high = ({r.quality: r for r in got}[y] for y in (0, 1))
    assert low["max(score)"] < high["min(score)"]


def test_boosting_over_blocks_equals_boosting_at_once(spark, docs, monkeypatch):
    df, labels = docs
    monkeypatch.setattr(quality, "BLOCK_ROWS", 60)
    model = quality.fit_classifier(df, labels, rounds=4)
    known = quality.labelled_statistics(df, labels, "quality")
    x, y = stats.features(np.array(known.select(*stats.NAMES).collect())), np.array([r[0] for r in known.select("__label").collect()])
    cuts = quality._cuts(known)
    bins = forests.binned(x, cuts)

    def histograms(splits, tree, level):
        return splits.histograms(bins, y, splits.advanced(bins, None, 0, tree), tree, level)

    same = forests.grow_boosted(cuts, (y.sum() + 0.5) / (len(y) + 1), histograms, rounds=4)
    assert (model.trees.feature == same.trees.feature).all() and (model.trees.threshold == same.trees.threshold).all()
    assert (model.predict(x) == same.predict(x)).all()
