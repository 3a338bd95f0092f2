"""Scoring by a join on position against the array form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scoring as sc
from tidewheel.operators import long_scoring as lg
from tidewheel.operators import training as tr

NAN, INF = float("nan"), float("inf")


def record(spark, theta, sigma, prior):
    row = (
        [1.0] * len(prior),
        list(prior),
        list(range(3, 3 + len(prior))),
        [list(map(float, t)) for t in theta],
        [list(map(float, s)) for s in sigma],
    )
    return spark.createDataFrame([row], sc_schema())


def sc_schema():
    from tidewheel.schemas import MODEL_SCHEMA

    return MODEL_SCHEMA


def vectors(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "key int, x array<double>")


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(2)
    theta, sigma = rng.normal(size=(4, 23)), rng.uniform(0.5, 2, size=(4, 23))
    stored = record(spark, theta, sigma, [0.1, 0.2, 0.3, 0.4])
    rows = [list(map(float, v)) for v in rng.normal(size=(60, 23))]
    rows += [rows[0], [NAN] * 23, [INF] + [0.0] * 22, [None] + [0.0] * 22]
    return stored, vectors(spark, rows)


@pytest.mark.parametrize("block,spread", [(5, 3), (23, 1), (512, None)])
def test_equals_array_form(case, block, spread):
    stored, rows = case
    model = sc.load_model(stored)
    long = lg.stored_model_rows(stored)
    scores = lg.nb_log_likelihood_long(rows, "key", "x", long, block, spread).collect()
    found = {(r.key, r.class_): r.log_likelihood for r in scores}
    assert len(scores) == len(found) == rows.count() * 4
    expected = rows.select("key", sc.nb_log_likelihood("x", model).alias("s"))
    for r in expected.collect():
        got = [found[r.key, c] for c in model.classes]
        assert np.allclose(got, r.s, rtol=1e-12, equal_nan=True)
    chosen = lg.nb_predict_long(rows, "key", "x", long, block=block, spread=spread)
    array = sc.nb_predict_batch(rows, "x", model).select("key", "predicted", "positive")
    assert sorted(chosen.collect()) == sorted(array.collect())


@pytest.mark.parametrize(
    "theta,sigma,prior",
    [
        ([[1, 2], [1, 2]], [[1, 1], [1, 1]], [0.5, 0.5]),  # ties go to the first class
        ([[1, 2], [3, 4]], [[1, 0], [1, 1]], [0.5, 0.5]),  # no variance
        ([[1, 2], [3, 4]], [[1, 1], [1, 1]], [0.0, 1.0]),  # no such class
    ],
)
def test_odd_models(spark, theta, sigma, prior):
    stored = record(spark, theta, sigma, prior)
    rows = vectors(spark, [[1.0, 2.0], [3.0, 4.0], [1.0, 4.0], [1.0], None, [1.0, 2.0, 3.0]])
    found = lg.nb_predict_long(rows, "key", "x", lg.stored_model_rows(stored))
    array = sc.nb_predict_batch(rows, "x", sc.load_model(stored))
    assert sorted(found.collect()) == sorted(array.select("key", "predicted", "positive").collect())


def test_columns_and_trained_models(spark):
    rows = spark.range(200).select(
        F.col("id").alias("key"),
        (F.col("id") % 2).cast("int").alias("target"),
        (F.sin("id") + F.col("id") % 2).alias("a"),
        F.cos("id").alias("b"),
    )
    stored = tr.nb_model(rows, ["a", "b"])
    found = lg.nb_predict_long(rows, "key", ["a", "b"], lg.stored_model_rows(stored), block=1)
    array = sc.nb_predict_batch(rows, ["a", "b"], sc.load_model(stored))
    assert sorted(found.collect()) == sorted(array.select("key", "predicted", "positive").collect())
    assert found.limit(0).count() == 0
    none = lg.nb_predict_long(rows.limit(0), "key", ["a", "b"], lg.stored_model_rows(stored))
    assert none.collect() == []


def test_joins_blocks_by_position_and_copy(spark, case):
    stored, rows = case
    long = lg.stored_model_rows(stored)
    df = lg.nb_log_likelihood_long(rows, "key", "x", long, 5, 4)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
