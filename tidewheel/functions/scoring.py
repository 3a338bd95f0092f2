"""Gaussian Naive Bayes scoring as column expressions.

The model is loaded once and becomes constants of the query, so scoring is map-only:
no join, no shuffle. A small model is unrolled into plain arithmetic that stays in
generated code. A larger one would compile into a method too long for the JIT, so it
runs as an Arrow function over whole batches instead; both add the same terms in the
same order, so they give the same numbers to the last bit.

Arithmetic follows IEEE rules throughout: a zero variance, a NaN or an infinite
feature ends in the first class, as an argmax over NaN does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this many class x feature terms the Arrow form is the faster one.
EXPRESSION_TERMS = 48
# A model is constants in every task; anything near this size is not one.
MAX_MODEL_TERMS = 20_000_000


@dataclass(frozen=True)
class Model:
    """Model parameters on the driver: classes x features numbers."""

    classes: np.ndarray
    class_count: np.ndarray
    class_prior: np.ndarray
    theta: np.ndarray
    sigma: np.ndarray

    @property
    def n_features(self) -> int:
        return self.theta.shape[1]

    @property
    def terms(self) -> int:
        return self.theta.size

    @property
    def offset(self) -> np.ndarray:
        """The part of each class's log-likelihood that no feature enters."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return -0.5 * np.log(2 * np.pi * self.sigma).sum(axis=1)

    @property
    def weight(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return -0.5 / self.sigma

    @property
    def log_prior(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(self.class_prior)


def load_model(record: DataFrame, max_terms: int = MAX_MODEL_TERMS) -> Model:
    """Fetch the one model record in one action; a record above ``max_terms`` stays
    where it is and is refused."""
    classes = F.size("theta_")
    terms = classes * F.coalesce(F.size(F.get("theta_", F.lit(0))), F.lit(0))
    small = terms.between(1, max_terms)
    names = ("classes_", "class_count_", "class_prior_", "theta_", "sigma_")
    found = record.select(
        terms.alias("terms"), *[F.when(small, F.col(n)).alias(n) for n in names]
    ).take(2)
    if len(found) != 1:
        raise ValueError(f"expected one model record, found {len(found) or 'none'}")
    (row,) = found
    if row["theta_"] is None:
        raise ValueError(f"model has {row['terms']} terms, allowed are 1 to {max_terms}")
    return Model(
        classes=np.array(row["classes_"]),
        class_count=np.array(row["class_count_"], dtype=float),
        class_prior=np.array(row["class_prior_"], dtype=float),
        theta=np.array(row["theta_"], dtype=float),
        sigma=np.array(row["sigma_"], dtype=float),
    )


def feature_array(features: str | Column | Sequence[str]) -> Column:
    if isinstance(features, str):
        return F.col(features)
    if isinstance(features, Column):
        return features
    return F.array(*[F.col(name).cast("double") for name in features])


def _unrolled(features, model: Model, start: np.ndarray) -> Column:
    if isinstance(features, (str, Column)):
        array = feature_array(features)
        parts = [F.get(array, F.lit(i)) for i in range(model.n_features)]
    else:
        array = None
        parts = [F.col(name) for name in features]
    parts = [F.coalesce(p.cast("double"), F.lit(float("nan"))) for p in parts]
    weight = model.weight
    scores = []
    for c in range(len(model.classes)):
        terms = []
        for i, part in enumerate(parts):
            gap = part - F.lit(float(model.theta[c, i]))
            terms.append(gap * gap * F.lit(float(weight[c, i])))
        scores.append(reduce(lambda a, b: a + b, terms, F.lit(float(start[c]))))
    if array is None:
        return F.array(*scores)
    return F.when(F.size(array) == model.n_features, F.array(*scores))


def _batched(features, model: Model, start: np.ndarray) -> Column:
    theta, weight, width = model.theta, model.weight, model.n_features

    def score(vectors: pa.Array) -> pa.Array:
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        x = np.asarray(flat, dtype=float).reshape(-1, width)
        scores = np.empty((len(x), len(start)))
        with np.errstate(all="ignore"):
            for c in range(len(start)):
                total = np.full(len(x), start[c])
                # One feature after the other, as the expression adds them.
                for i in range(width):
                    gap = x[:, i] - theta[c, i]
                    total += gap * gap * weight[c, i]
                scores[:, c] = total
        ends = np.concatenate(([0], np.cumsum(known))) * len(start)
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(scores.ravel()), mask=pa.array(~known)
        )

    array = feature_array(features).cast("array<double>")
    return F.arrow_udf(score, "array<double>")(
        F.when(F.size(array) == width, array)
    )


def _scores(features, model: Model, start: np.ndarray, form: str) -> Column:
    if form == "auto":
        form = "expression" if model.terms <= EXPRESSION_TERMS else "batch"
    if not isinstance(features, (str, Column)) and len(features) != model.n_features:
        raise ValueError(f"{len(features)} features, model has {model.n_features}")
    return {"expression": _unrolled, "batch": _batched}[form](features, model, start)


def nb_log_likelihood(features, model: Model, form: str = "auto") -> Column:
    """Log-likelihood per class, in class order, as array<double>.

    ``features`` is a list of column names or one array column. A missing feature
    counts as NaN; an array of another length than the model's gives NULL.
    """
    return _scores(features, model, model.offset, form)


def nb_log_joint(features, model: Model, form: str = "auto") -> Column:
    """Log prior plus log-likelihood per class."""
    with np.errstate(invalid="ignore"):
        return _scores(features, model, model.log_prior + model.offset, form)


def nb_proba(log_joint: str | Column) -> Column:
    """Class probabilities from log joints, shifted by their maximum first."""
    joint = F.col(log_joint) if isinstance(log_joint, str) else log_joint
    # The maximum and the total are worked out once a row, as parts of a struct that a
    # one-element transform binds.
    def share(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
        bound = F.transform(F.array(total), lambda t: F.transform(parts, lambda v: v / t))
        return F.get(bound, F.lit(0))

    def shift(top: Column) -> Column:
        return F.transform(joint, lambda v: F.exp(v - top))

    shifted = F.get(F.transform(F.array(F.array_max(joint)), shift), F.lit(0))
    return F.get(F.transform(F.array(shifted), share), F.lit(0))


def nb_argmax(log_joint: str | Column, model: Model) -> Column:
    """The class with the highest score; on a tie the first one.

    NaN sorts above every number, so the maximum is NaN as soon as one score is.
    """
    joint = F.col(log_joint) if isinstance(log_joint, str) else log_joint
    best = F.array_max(joint)
    undecided = F.isnan(best) | (best == F.lit(float("-inf")))
    place = F.when(undecided, F.lit(1)).otherwise(F.array_position(joint, best))
    classes = F.array(*[F.lit(int(c)) for c in model.classes])
    return F.when(joint.isNotNull(), F.element_at(classes, place.cast("int")))


def nb_is_positive(predicted: str | Column) -> Column:
    return (F.col(predicted) if isinstance(predicted, str) else predicted) == 1


def nb_predict_batch(
    df: DataFrame,
    features,
    model: Model,
    form: str = "auto",
    predicted: str = "predicted",
    positive: str = "positive",
) -> DataFrame:
    """Add the predicted class and whether it is class 1 to every row."""
    scored = df.withColumn("_joint", nb_log_joint(features, model, form))
    return (
        scored.withColumn(predicted, nb_argmax("_joint", model))
        .withColumn(positive, nb_is_positive(predicted))
        .drop("_joint")
    )
