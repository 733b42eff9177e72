"""The two classifiers: parts against brute force, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality_model, toxicity
from lattica.llm.labelled import fold, one_label

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (None, "Idiot."), (3, ""), (3, ""), (4, "w" * 5000), (5, " \n ")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_folds(spark):
    got = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5, 0).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: False}


def test_contradicting_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in one_label(labels, "toxic").collect()] == [(2, 1)]


# --- toxicity


def subsequences(s, t, decay=toxicity.DECAY):
    total = 0.0
    for a in itertools.combinations(range(len(s)), 3):
        for b in itertools.combinations(range(len(t)), 3):
            if all(s[x] == t[y] for x, y in zip(a, b)):
                total += decay ** (a[2] - a[0] + 1 + b[2] - b[0] + 1)
    return total


def test_kernel_against_enumeration():
    words = ["idiot", "id-iot", "abab", "éàé", "xxxxxx", "toidi"]
    got = toxicity.Kernel(["idiot", "abba", "xxx"]).values(words)
    norm = lambda s: subsequences(s, s) ** 0.5
    want = [[subsequences(w, m) / norm(w) / norm(m) for m in ("idiot", "abba", "xxx")] for w in words]
    assert got == pytest.approx(np.array(want), rel=1e-4, abs=1e-6)


def test_tokens():
    assert toxicity.tokens("You, i-d.iot! is a") == {"^you", "^i-d.iot", "^idiot"}
    assert "^idiot" in toxicity.tokens("i d i o t")
    long = toxicity.tokens("x" * 30 + "insult" + "y" * 40)
    assert all(len(t) <= toxicity.PIECE for t in long) and any("insult" in t for t in long)


def test_long_rows_of_marks_take_no_time():
    import time

    began = time.time()
    for text in ("Name: " + "_" * 10_000 + "ab", "a" + " _" * 10_000 + "!", "i-" * 10_000 + "d", "x" + "_" * 200_000):
        toxicity.tokens(text)
    assert time.time() - began < 1
    assert "^idiot" in toxicity.tokens("i_d_i_o_t") and "^idiot" in toxicity.tokens("what an i__d i--o t")


def test_training_takes_one_text_an_id(spark):
    rows = [(i, "you stupidhead go away " + "filler" * (i % 3)) for i in range(30)] + [(100 + i, f"kind words number {i} of a friend") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    again = docs.union(docs.withColumn("text", F.concat(F.lit("~ "), "text")))
    score = lambda d: [round(x, 9) for x in toxicity.train(d, labels).probability(np.eye(7))]
    assert score(docs) == score(again) == score(again.repartition(7))


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 0.93
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03
    plain, tampered, harmless = (model.probability(model.summaries([toxicity.tokens(t)]))[0] for t in ("You are a stupid moron.", "You are a stu-pid mor.on.", "You are a very kind person."))
    assert plain > 0.5 and tampered > 0.5 and harmless < 0.5
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("label", F.lit("x"))
    scores = toxicity.classify(odd, labels.limit(0)).collect()
    assert len(scores) == len(ODD) and all(r.score == 0 for r in scores)
    assert toxicity.score_toxicity(odd.select("doc_id", "text"), model).count() == len(ODD)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


# --- quality


def test_quality_held_out(spark, tables):
    docs, labels = tables
    rows = quality_model.classify(docs.withColumn("score", F.lit(2)), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    assert {r.score for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_rows_labelled_0_change_no_score(spark, tables):
    docs, labels = tables
    few = docs.filter("doc_id < 60")
    score = lambda x: sorted((r.doc_id, r.score) for r in quality_model.score_quality(few, quality_model.train(docs, x, 300, 400)).collect())
    want = score(labels)
    assert want == score(labels.filter("quality = 1")) == score(labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1.2, 1, (4000, 6)).astype(np.float32), rng.normal(-1.2, 1, (2000, 6)).astype(np.float32)
    n = int(2000 * share)
    assert quality_model.class_prior(good[:2000], np.concatenate([good[2000 : 2000 + n], bad[: 2000 - n]])) == pytest.approx(share, abs=0.08)
    assert quality_model.class_prior(good[:5], bad) == 0.5


def test_very_long_and_odd_texts_have_features():
    for text in (b"word " * 400_000, b"\0" * 10, "é\u2028".encode() * 1000, b" \n\t"):
        assert np.isfinite(quality_model.features(text)).all()


def test_risk_uses_no_negative_labels():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (2000, 5)).astype(np.float32), rng.normal(-1.5, 1, (600, 5)).astype(np.float32)
    model = quality_model.fit(good[:1000], np.concatenate([good[1000:], bad[:300]]), 1000 / 1300, epochs=60)
    assert model.score(bad[300:]).mean() < 0.2 and model.score(good).mean() > 0.9


def test_features_read_the_whole_text():
    a, b = b"word other " * 4000, b"word other " * 3999 + b"word oth$r "
    assert not np.array_equal(quality_model.features(a), quality_model.features(b))
    assert np.isfinite(quality_model.features(None)).all()
