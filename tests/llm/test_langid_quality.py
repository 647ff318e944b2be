from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, langid, quality
from plumbline.llm.queries import op3_language, op6_quality

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_languages_are_right(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = op3_language(spark, MIDDLE).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.truth == r.lang_pred for r in held) / len(held) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_learned_rows_count(spark):
    """A language that only held-out rows have can't be predicted."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert langid.detect(docs).where("lang_pred = 'xx'").count() == 0


def test_three_languages_of_one_family():
    rng = np.random.default_rng(3)
    words = {"en": "the and of that with this", "de": "der und das mit nicht ein", "nl": "het een van niet met voor", "fr": "les des que pour dans une", "ja": "これ は です の を"}
    made = lambda lang: " ".join(rng.choice(words[lang].split(), 12))
    texts = [(made(v), v) for v in words for _ in range(30)]
    x = np.ones((len(texts), langid.FEATURES + 1), np.float32)
    x[:, :-1] = [langid.features(t) for t, _ in texts]
    model = langid.Model(x, [v for _, v in texts])
    assert model.languages["germanic"] == ["de", "en", "nl"] and model.languages["=ja"] == ["ja"]
    for v in words:
        for _ in range(10):
            found, score = model.predict(langid.features(made(v)))
            assert found == v and 0 < score < 1


def test_odd_rows_of_languages(odd, none):
    rows = langid.detect(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[1].lang_pred != "und"
    assert not by[None].held_out
    assert langid.detect(none).count() == 0
    unlabelled = langid.detect(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    some = langid.sample(docs, F.lit(True), "doc_id", "text", "lang", 40)
    counts = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
    assert sum(counts.values()) <= 40 and max(counts.values()) <= 10 and len(counts) == 4


def test_quality_follows_the_labels(spark):
    """Nothing is learned from the labels; they only judge."""
    rows = op6_quality(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality], [r.keep for r in rows if not r.quality]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = np.array([0.95, 0.85, 0.8, 0.75, 0.6])
    votes = np.where(rng.random((20000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 5)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rates = quality.estimate(patterns, counts.astype(float))
    accuracy = [prior * rates[j, 1, 2] / (1 - rates[j, 1, 0]) + (1 - prior) * rates[j, 0, 1] / (1 - rates[j, 0, 0]) for j in range(5)]
    assert prior == pytest.approx(0.7, abs=0.03) and accuracy == pytest.approx(right, abs=0.03)


def test_em_equals_steps_written_out():
    """Two labellers, one of which says nothing at times: each step as sums over single texts."""
    votes = [(1, 1)] * 6 + [(0, 0)] * 3 + [(1, 0)] * 2 + [(0, -1)] * 2 + [(1, -1)] * 4 + [(-1, -1)]
    prior, right = 0.8, [[0.8, 0.8], [0.8, 0.8]]  # right[labeller][truth]
    for _ in range(3):
        p = []
        for v in votes:
            like = [1 - prior, prior]
            for truth in (0, 1):
                for j, x in enumerate(v):
                    if x != -1:
                        like[truth] *= right[j][truth] if x == truth else 1 - right[j][truth]
            p.append(like[1] / sum(like))
        prior = sum(p) / len(p)
        for j in range(2):
            for truth in (0, 1):
                weight = [(x if truth else 1 - x) for x in p]
                agree = sum(w for w, v in zip(weight, votes, strict=True) if v[j] == truth)
                differ = sum(w for w, v in zip(weight, votes, strict=True) if v[j] == 1 - truth)
                right[j][truth] = (agree + 1) / (agree + differ + 2)
    patterns, counts = np.unique(np.array(votes), axis=0, return_counts=True)
    got, rates = quality.estimate(patterns, counts.astype(float), rounds=3)
    assert got == pytest.approx(prior)
    assert [[rates[j, 0, 1], rates[j, 1, 2]] for j in range(2)] == [pytest.approx(x) for x in right]


def test_the_sample_keeps_its_size_among_copies(spark):
    good = [(f"The {n}th house stands by the river, and people walk past it every day.",) for n in range(60)]
    bad = [("#### %%%% " + "$ " * (20 + n),) for n in range(20)]
    docs = spark.createDataFrame(good + bad, "text string").union(spark.range(30000).selectExpr("'one text with many copies, and nothing else in it.' as text"))
    prior, rates, w = quality.train(docs, rows=40)
    assert np.isfinite(w).all() and np.abs(w).max() > 0


def test_predictions_follow_the_weights():
    """Families by the largest margin, then pairs of languages: written out for given weights."""
    model = langid.Model.__new__(langid.Model)
    model.families, model.languages = ["germanic", "romance"], {"germanic": ["de", "en", "nl"], "romance": ["fr"]}
    model.by_family = np.array([[1.0, 0.0, 0.5], [0.0, 1.0, 0.0]])
    model.pairs = {"germanic": [(0, 1), (0, 2), (1, 2)], "romance": []}
    model.by_pair = {"germanic": [np.array([1.0, 0.0, -1.0]), np.array([0.0, 1.0, 0.25]), np.array([2.0, 0.0, -1.0])], "romance": []}
    sig = lambda z: 1 / (1 + np.exp(-z))
    # x = (2, 0): germanic 2.5 to 0; de over en by 1, de over nl by 0.25, en over nl by 3: de wins twice, its least margin 0.25.
    assert model.predict(np.array([2.0, 0.0])) == ("de", pytest.approx(sig(5.0) * sig(0.5)))
    # x = (0, 0): germanic 0.5; en over de by 1, de over nl by 0.25, nl over en by 1: one each; sums de -0.75, en 0, nl 0.75.
    assert model.predict(np.array([0.0, 0.0])) == ("nl", pytest.approx(sig(1.0) * sig(-0.5)))
    assert model.predict(np.array([0.0, 3.0])) == ("fr", pytest.approx(sig(6.0)))


@pytest.mark.parametrize("text", ["²½ ①② 12", "_ _ 4", "…", "٣٤"])
def test_only_letters_make_a_language(spark, text):
    docs = spark.createDataFrame([(n, f"the house {n} and the river", "en") for n in range(8)] + [(100, text, None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in langid.detect(docs).collect()}
    assert (by[100].lang_pred, by[100].score) == ("und", 0.0) and by[1].lang_pred == "en"


def test_odd_rows_of_quality(odd, none):
    model = quality.train(odd)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(not r.keep and r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert quality.kept(odd, model).columns == odd.columns
    assert quality.train(none) is None and quality.classify(none).count() == 0
    assert quality.score(odd, None).where("keep").count() == 0


def test_batches_are_bounded_in_rows_and_bytes(spark):
    """Long texts make batches of fewer rows; settings that are smaller already stay."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("10000", "64m"), strict=True):
            spark.conf.set(k, v)
        common.small_batches(spark)
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"]) for b in batches)
        long = spark.range(200, numPartitions=1).select(F.repeat(F.lit("abcdefghij"), 20_000).alias("t"))
        got = long.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 200 and max(r.bytes for r in got) < common.BYTES + 300_000
        assert max(r.n for r in spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long, bytes long").collect()) == common.BATCH
        for k, v in zip(keys, ("100", "1m"), strict=True):
            spark.conf.set(k, v)
        common.small_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["100", "1m"]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
