"""Training and scoring against their definitions."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scoring as sc
from tidewheel.operators import training as tr
from tidewheel.plans import tables as tb
from tidewheel.schemas import FEATURE_COLUMNS
from tidewheel.sources import lake, model_store
from tidewheel.plans.training_job import train_from_csv

FORMS = ["expression", "batch"]


def predict(x, classes, prior, theta, sigma):
    """Bayes' rule with the standard library's normal density, in exact log sums."""
    joint = []
    for share, means, variances in zip(prior, theta, sigma):
        densities = (
            NormalDist(mean, math.sqrt(variance)).pdf(value)
            for value, mean, variance in zip(x, means, variances)
        )
        joint.append(math.fsum(map(math.log, [share, *densities])))
    best = joint.index(max(joint))
    # The evidence relative to the best class, so that no density underflows.
    odds = [math.exp(j - joint[best]) for j in joint]
    return classes[best], [o / math.fsum(odds) for o in odds]


def model(prior, theta, sigma, classes=None):
    classes = classes if classes is not None else list(range(len(prior)))
    return sc.Model(
        np.array(classes),
        np.ones(len(prior)),
        np.array(prior, dtype=float),
        np.array(theta, dtype=float),
        np.array(sigma, dtype=float),
    )


def wide_csv(tmp_path, rows=400, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.choice(["M", "B", "?"], rows, p=[0.35, 0.6, 0.05])
    x = rng.normal(10, 3, (rows, 30)) + (label == "M")[:, None] * rng.normal(0, 2, 30)
    path = tmp_path / "data.csv"
    with open(path, "w") as out:
        for i in range(rows):
            out.write(f"{i},{label[i]}," + ",".join(repr(float(v)) for v in x[i]) + "\n")
    return str(path), label, x


def test_csv_to_stored_model_to_scores(spark, tmp_path):
    path, label, x = wide_csv(tmp_path)
    stored = str(tmp_path / "model")
    train_from_csv(spark, path, stored)
    m = sc.load_model(model_store.model_json_read(spark, stored))

    y = np.array([{"M": 1, "B": 0}.get(v, -1) for v in label])
    assert m.classes.tolist() == [0, 1]
    assert m.class_count.tolist() == [(y == 0).sum(), (y == 1).sum()]
    assert math.isclose(m.class_prior.sum(), 1)
    for i, c in enumerate((0, 1)):
        np.testing.assert_allclose(m.theta[i], x[y == c].mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(m.sigma[i], x[y == c].var(axis=0), rtol=1e-10)

    rows = lake.csv_named_scan(spark, path)
    wanted = [
        predict(v, m.classes.tolist(), m.class_prior, m.theta, m.sigma)[0] for v in x
    ]
    for form in FORMS:
        found = sc.nb_predict_batch(rows, FEATURE_COLUMNS, m, form).orderBy("id")
        assert [r["predicted"] for r in found.select("predicted").collect()] == wanted


def test_array_columns_train_and_score_like_wide_ones(spark, tmp_path):
    path, _, _ = wide_csv(tmp_path, seed=2)
    wide = lake.csv_named_scan(spark, path).withColumn(
        "target", tr.recode_label("target")
    )
    array = wide.select("id", "target", F.array(*FEATURE_COLUMNS).alias("x"))
    a = tr.nb_model(wide, FEATURE_COLUMNS)
    b = tr.nb_model(array, "x")
    assert a.collect() == b.collect()
    m = sc.load_model(a)
    joints = [
        df.select("id", sc.nb_log_joint(x, m, form).alias("j")).orderBy("id").collect()
        for df, x in ((wide, FEATURE_COLUMNS), (array, "x"))
        for form in FORMS
    ]
    # Both forms add in one order, so the numbers are the same to the last bit.
    assert all([r["j"] for r in joints[0]] == [r["j"] for r in other] for other in joints[1:])


def test_labels(spark):
    df = spark.createDataFrame([("M",), ("B",), ("x",), (None,)], "target string")
    coded = df.withColumn("target", tr.recode_label("target"))
    assert [r[0] for r in coded.collect()] == [1, 0, None, None]
    assert tr.label_counts(coded).first().asDict() == {"labelled": 2, "unmapped": 2}
    assert [r[0] for r in tr.nb_classes(coded).collect()] == [0, 1]


def test_missing_feature_is_nan(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, 2.0)], "target int, a double")
    m = sc.load_model(tr.nb_model(df, ["a"]))
    assert math.isnan(m.theta[0, 0]) and m.theta[1, 0] == 2.0


def test_smoothing_is_added_to_every_variance(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "target int, a double")
    m = sc.load_model(tr.nb_model(df, ["a"], smoothing=0.5))
    assert m.sigma.tolist() == [[0.5], [0.5]]


def test_a_label_of_too_many_values_is_refused(spark):
    df = spark.range(50).selectExpr("cast(id as int) target", "1.0d a")
    assert len(sc.load_model(tr.nb_model(df, ["a"], max_classes=50)).classes) == 50
    with pytest.raises(Exception, match="class_count"):
        tr.nb_model(df, ["a"], max_classes=49).collect()


def test_ragged_array_fails_training(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "target int, x array<double>")
    with pytest.raises(Exception, match="feature_count"):
        tr.nb_model(df, "x", n_features=2).collect()


CASES = {
    "plain": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [1.9, 2.2]),
    "tie": (model([0.5, 0.5], [[0, 0], [0, 0]], [[1, 1], [1, 1]]), [1.0, 1.0]),
    "zero variance": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 0]]), [2.0, 2.0]),
    "zero variance, off mean": (
        model([0.5, 0.5], [[9, 9], [2, 2]], [[0, 1], [1, 1]]),
        [2.0, 2.0],
    ),
    "nan": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [math.nan, 2.0]),
    "infinite": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [math.inf, 2.0]),
    "overflow": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [1e200, 2.0]),
    "zero prior": (model([0, 1], [[2, 2], [0, 0]], [[1, 1], [1, 1]]), [2.0, 2.0]),
    "all priors zero": (model([0, 0], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [2.0, 2.0]),
    "three classes": (
        model([0.2, 0.3, 0.5], [[0, 0], [2, 2], [4, 4]], [[1, 1]] * 3, [3, 5, 1]),
        [4.0, 4.0],
    ),
    "far from all": (model([0.5, 0.5], [[0, 0], [2, 2]], [[1, 1], [1, 1]]), [900.0, 900.0]),
}


NOTHING = (0, [math.nan, math.nan])
# Where a density has no value, or none has a size, the first class is the answer.
ANSWERS = {
    "zero variance": NOTHING,
    "zero variance, off mean": NOTHING,
    "nan": NOTHING,
    "infinite": NOTHING,
    "overflow": NOTHING,
    "zero prior": (1, [0.0, 1.0]),
    "all priors zero": NOTHING,
    "far from all": (1, [0.0, 1.0]),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("case", CASES)
def test_scores_follow_the_definition(spark, case, form):
    m, x = CASES[case]
    wanted, wanted_p = ANSWERS.get(case) or predict(
        x, m.classes.tolist(), m.class_prior, m.theta, m.sigma
    )
    df = spark.createDataFrame([(*x, x)], "a double, b double, x array<double>")
    for features in (["a", "b"], "x"):
        row = (
            df.withColumn("j", sc.nb_log_joint(features, m, form))
            .select(sc.nb_argmax("j", m).alias("c"), sc.nb_proba("j").alias("p"))
            .select("c", "p", sc.nb_is_positive("c").alias("positive"))
            .first()
        )
        assert row["c"] == wanted
        assert row["positive"] == (wanted == 1)
        np.testing.assert_allclose(row["p"], wanted_p, atol=1e-12)


@pytest.mark.parametrize("form", FORMS)
def test_other_width_gives_no_score(spark, form):
    m = CASES["plain"][0]
    df = spark.createDataFrame(
        [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, None), (3, []), (4, [2.0, 2.0])],
        "i int, x array<double>",
    )
    rows = sc.nb_predict_batch(df, "x", m, form).orderBy("i").collect()
    assert [r["positive"] for r in rows] == [None, None, None, None, True]
    with pytest.raises(ValueError, match="3 features"):
        sc.nb_log_joint(["a", "b", "c"], m)


def test_model_is_checked_before_it_is_fetched(spark, sf_dir):
    record = tb.line_model_record(spark, sf_dir)
    with pytest.raises(ValueError, match="8 terms"):
        sc.load_model(record, max_terms=7)
    with pytest.raises(ValueError, match="none"):
        sc.load_model(record.limit(0))


def test_invariants_on_embeddings(spark, sf_dir):
    m = tb.embedding_model(spark, sf_dir)
    assert math.isclose(m.class_prior.sum(), 1)
    assert m.class_count.sum() == tb.embedding_rows(spark, sf_dir).count()
    assert (m.sigma >= 0).all()
    rows = (
        tb.embedding_rows(spark, sf_dir)
        .select(sc.nb_log_joint("embedding", m).alias("j"))
        .select(sc.nb_proba("j").alias("p"), sc.nb_argmax("j", m).alias("c"))
        .collect()
    )
    assert all(math.isclose(sum(r["p"]), 1) for r in rows)
    assert {r["c"] for r in rows} <= set(m.classes.tolist())
