"""Positive-unlabelled learning: held-out accuracy and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F
from corpus_words import sentence
from tidewheel.llm import toxicity
from tidewheel.llm.queries import held_out, op1_pu_toxicity


def test_risk_learns_from_positive_and_unlabelled_alone():
    rng = np.random.default_rng(1)

    def rows(n, toxic):
        return [
            np.unique(np.append(rng.integers(10, 400, 30), [1, 2] if toxic else [3]))
            for _ in range(n)
        ]

    positive = rows(200, True)
    hidden = rows(90, True)
    model = toxicity.fit(positive, hidden + rows(810, False), prior=0.1)
    assert np.mean([model.score(r) >= 0.7 for r in rows(200, True)]) > 0.95
    assert np.mean([model.score(r) >= 0.7 for r in rows(200, False)]) < 0.02


def test_nothing_confirmed_scores_near_zero(spark, corpus, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(corpus, labels, F.lit(True))
    rows = toxicity.toxicity_scores(corpus, model).collect()
    assert len(rows) == corpus.count()
    assert all(0 <= r["score"] < 0.01 and r["predicted"] == 0 for r in rows)
    assert toxicity.toxicity_scores(nothing, model).count() == 0


def test_odd_rows_are_scored(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(sentence(rng, 30) + ["villain"] * (i % 4 == 0))) for i in range(400)]
    docs += [(900, None), (901, ""), (None, "a villain"), (902, "Villain, " * 5000)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i in range(0, 400, 2)] * 2, "doc_id bigint, toxic int"
    )
    model = toxicity.train(docs, labels, F.lit(True), prior=0.25)
    scored = toxicity.toxicity_scores(docs, model)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert rows[900]["score"] == rows[901]["score"] < 0.5
    assert rows[None]["predicted"] == rows[902]["predicted"] == 1
    assert np.mean([rows[i]["predicted"] == (i % 4 == 0) for i in range(400)]) > 0.97
    assert scored.columns == ["doc_id", "text", "score", "predicted"]


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = op1_pu_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.6
    assert np.mean(clean) < 0.02


def test_labels_are_learnt_from_usable_rows_alone(spark):
    docs = spark.createDataFrame(
        [(i, f"w{i % 7} word{i} bad{i}") for i in range(200)], "doc_id bigint, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels, ~held_out()) == toxicity.train(docs, flipped, ~held_out())


def test_sample_is_bounded_and_exact_whatever_the_ids(spark):
    """A third of all rows share one id, as many are one row again and again."""
    rows = [(7, f"text {i}") for i in range(3_000)] + [(8, "the same")] * 3_000
    rows += [(i, f"own {i}") for i in range(10, 3_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    hashed = docs.withColumn("_hash", F.xxhash64(F.lit(23), "doc_id", "text"))
    for most in (1, 500, 5_000, 100_000):
        sample = toxicity._sample(hashed, most)
        assert len(toxicity._feature_rows(sample, "text", most)) == min(most, 5_991)
        every = sorted({r["_hash"] for r in hashed.collect()})
        found = sorted(r["_hash"] for r in sample.collect())
        assert found[:most] == every[:most] and len(found) <= 2 * (most + 100)
    assert toxicity._feature_rows(toxicity._sample(hashed.limit(0), 5), "text", 5) == []


def plain_fit(positive, unlabelled, prior, epochs, rate=0.05, decay=5e-4):
    """The same risk and steps on dense rows, gradients from its definition."""
    n = 1 + max(int(r.max()) for r in positive + unlabelled)
    dense = [np.zeros((len(s), n + 1)) for s in (positive, unlabelled)]
    for matrix, side in zip(dense, (positive, unlabelled)):
        matrix[:, -1] = 1
        for i, own in enumerate(side):
            matrix[i, own] = 1
    p, u = dense
    w = np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior + 1e-9))
    first, second, later = np.zeros(n + 1), np.zeros(n + 1), []
    for step in range(1, epochs + 1):
        sp, su = (1 / (1 + np.exp(-m @ w)) for m in (p, u))
        toxic_as_clean = prior * (p * sp[:, None]).mean(axis=0)
        clean = (u * su[:, None]).mean(axis=0) - toxic_as_clean
        risk = np.mean(np.log1p(np.exp(u @ w))) - prior * np.mean(np.log1p(np.exp(p @ w)))
        toxic = prior * (p * (sp - 1)[:, None]).mean(axis=0)
        grad = toxic + clean if risk >= 0 else -clean
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if 2 * step > epochs:
            later.append(w)
    return np.mean(later, axis=0)


def test_risk_and_score_against_plain_numpy():
    rng = np.random.default_rng(4)

    def rows(n, toxic):
        return [
            np.unique(np.append(rng.integers(3, 30, 8), [1, 2] if toxic else [0])) for _ in range(n)
        ]

    positive, unlabelled = rows(40, True), rows(25, True) + rows(120, False)
    for prior in (0.15, 0.6):
        model = toxicity.fit(positive, unlabelled, prior, epochs=80, least_apart=0.0)
        expected = plain_fit(
            [r[np.isin(r, list(model.weights))] for r in positive],
            [r[np.isin(r, list(model.weights))] for r in unlabelled],
            prior,
            80,
        )
        for i, weight in model.weights.items():
            assert np.isclose(weight, expected[i], atol=1e-6), i
        assert np.isclose(model.bias, expected[-1], atol=1e-6)
        for own in rows(5, True):
            z = model.bias + sum(model.weights.get(int(i), 0.0) for i in own)
            assert np.isclose(model.score(own), 1 / (1 + np.exp(-z)))
