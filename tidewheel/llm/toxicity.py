"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and text without labels are learnt from. A linear model
minimises the unlabelled risk with the share of positives, known as the class prior,
taken out of its negative part; where that part falls below zero, which a true risk
cannot, the step is turned round so that the model does not fit single examples.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import text_column

BUCKETS = 1 << 20
# Bounds of what is fitted on: confirmed examples, and documents without labels.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000
MAX_FEATURES = 1 << 14
TIMES = (2, 4)
# Standard errors by which a feature's share of the examples must differ from its share
# of all text: weaker ones only help the model to tell single documents apart.
LEAST_APART = 6.0
EDGE = " \t\n\v\f\r.,;:!?\"'()[]{}<>|*#$%&-_/\\"


class WordFeatures(dict):
    """Hashed features of a word: the word and its first four and five letters."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.limit:
            self.clear()
        bare = word.strip(EDGE)
        names = [bare] if bare else []
        names += [f"{n}^{bare[:n]}" for n in (4, 5) if len(bare) >= n]
        hashes = (zlib.crc32(name.encode("utf-8", "replace")) for name in names)
        found = self[word] = tuple(h % BUCKETS for h in hashes)
        return found


def often(feature: int, times: int) -> int:
    """The feature that another one was met at least so many times."""
    return (feature * 31 + times * 7919) % BUCKETS


def features(text: str, cache: WordFeatures) -> np.ndarray:
    """Distinct features of a whole text, sorted: those of its words, and which of them
    were met twice and four times."""
    met: Counter[int] = Counter()
    for word, n in Counter(text.lower().split()).items():
        for feature in cache[word]:
            met[feature] += n
    found = set(met)
    for feature, n in met.items():
        found.update(often(feature, times) for times in TIMES if n >= times)
    return np.array(sorted(found), np.int32)


@dataclass(frozen=True)
class Model:
    """Weights by feature, at most MAX_FEATURES of them, and a bias."""

    weights: dict[int, float]
    bias: float

    def score(self, found: np.ndarray) -> float:
        z = self.bias + sum(self.weights.get(i, 0.0) for i in found.tolist())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Rows:
    """Sparse rows of ones: products with weights, and with values by row."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, values[self.row], self.width)


def fit(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    epochs: int = 300,
    rate: float = 0.05,
    decay: float = 5e-4,
    max_features: int = MAX_FEATURES,
    least_apart: float = LEAST_APART,
) -> Model:
    """Fit by the non-negative risk: prior * loss(P as 1) + max(0, loss(U as 0) -
    prior * loss(P as 0)), logistic loss, Adam steps on whole sets."""
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -60.0)
    p_seen = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    u_seen = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS)
    p_share = (p_seen + 0.5) / (len(positive) + 1)
    u_share = (u_seen + 0.5) / (len(unlabelled) + 1)
    # Features that set the confirmed examples apart, in standard errors.
    apart = np.abs(p_share - u_share) / np.sqrt(
        u_share * (1 - u_share) / len(positive)
    )
    seen = np.flatnonzero((p_seen >= 3) & (apart >= least_apart))
    chosen = np.sort(seen[np.argsort(-apart[seen], kind="stable")[:max_features]])
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def rows(sets: list[np.ndarray]) -> Rows:
        return Rows([own[own >= 0] for own in (place[s] for s in sets)], len(chosen))

    p, u = rows(positive), rows(unlabelled)
    weights, bias = np.zeros(len(chosen) + 1), np.log(prior / (1 - prior + 1e-9))
    weights[-1] = bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    mean, averaged = np.zeros_like(weights), 0
    for step in range(1, epochs + 1):
        zp, zu = p.times(weights) + weights[-1], u.times(weights) + weights[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_neg, gu = prior * sp / p.n, su / u.n
        if negative >= 0:
            gp = prior * (sp - 1) / p.n - gp_neg
            grad = np.append(p.back(gp) + u.back(gu), gp.sum() + gu.sum())
        else:
            grad = np.append(p.back(gp_neg) - u.back(gu), gp_neg.sum() - gu.sum())
        grad[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        weights -= (
            rate
            * (first / (1 - 0.9**step))
            / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        )
        # Turned steps make the weights swing; the mean of the later ones does not.
        if 2 * step > epochs:
            averaged += 1
            mean += (weights - mean) / averaged
    return Model(dict(zip(chosen.tolist(), mean[:-1].tolist())), float(mean[-1]))


def _feature_rows(rows: DataFrame, text: str, most: int) -> list[np.ndarray]:
    """Features of the ``most`` documents of smallest ``_hash`` of a sample; one short
    array a document. All tasks work features out before the rows are put in order."""
    source = rows.select("_hash", F.col(text).cast("string").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        for batch in batches:
            found = [features(t, cache).tobytes() for t in text_column(batch, "found")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary())], ["_hash", "found"]
            )

    worked = source.mapInArrow(run, "_hash bigint, found binary")
    chosen = worked.orderBy("_hash").limit(most).collect()
    return [np.frombuffer(r["found"], np.int32) for r in chosen]


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Rows among which are the ``most`` of smallest ``_hash``, which says id and text, and
    few others: a share of the hashes somewhat too large. Repeated rows are one."""
    n = rows.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    share = min(1.0, 1.3 * (most + 100) / max(n, 1))
    if share < 1.0:
        low = -(2**63)
        rows = rows.where(F.col("_hash") < low + int(share * 2**64))
    return rows.dropDuplicates(["_hash"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    prior: float | None = None,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """A model from the usable rows of ``labels`` with label 1 and from documents
    whose labels are not looked at.

    ``usable`` is a condition on ``doc_id``; documents and labels it does not hold for
    are not used. Without ``prior`` the share of label 1 in the usable labels is taken.
    The sample is bounded whatever the ids: the ``max_positive`` labelled ids of smallest
    hash, of their rows as many at most, and the ``max_unlabelled`` usable rows of smallest
    hash of id and text; rows equal in both are one. Null ids, null labels and empty texts
    teach nothing. Without a confirmed example every score
    is near 0.
    """
    known = labels.where(usable & F.col(doc_id).isNotNull() & F.col(toxic).isNotNull())
    total, ones = known.agg(
        F.count(F.lit(1)), F.sum((F.col(toxic) == 1).cast("int"))
    ).first()
    if not ones:
        return Model({}, -60.0)
    order = F.xxhash64(F.lit(17), F.col(doc_id))
    confirmed = (
        known.where(F.col(toxic) == 1)
        .select(doc_id)
        .distinct()
        .orderBy(order, doc_id)
        .limit(max_positive)
    )
    texts = docs.where(usable & F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(
        doc_id, text, F.xxhash64(F.lit(23), F.col(doc_id), F.col(text)).alias("_hash")
    )
    named = texts.join(F.broadcast(confirmed), doc_id)
    positive = _feature_rows(_sample(named, max_positive), text, max_positive)
    unlabelled = _feature_rows(_sample(texts, max_unlabelled), text, max_unlabelled)
    return fit(positive, unlabelled, prior if prior is not None else ones / total)


def toxicity_scores(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    threshold: float = 0.7,
    out: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """Every row of ``docs`` with its score from 0 to 1 and the prediction.

    Whole texts are scored, rows one by one: repeated rows get equal scores, and a
    null or empty text that of a text without known words. Columns of ``docs`` named
    like an output are replaced; an empty table gives an empty table.
    """
    kept = [f for f in docs.schema.fields if f.name not in out]
    source = docs.select(
        *[f.name for f in kept], F.col(text).cast("string").alias(out[0])
    )
    schema = T.StructType(
        [
            *kept,
            T.StructField(out[0], T.DoubleType()),
            T.StructField(out[1], T.IntegerType()),
        ]
    )
    weights, bias = model.weights, model.bias

    class Weighted(WordFeatures):
        """Only the features that have a weight."""

        def __missing__(self, word: str) -> tuple[int, ...]:
            found = super().__missing__(word)
            self[word] = known = tuple(
                i
                for i in found
                if i in weights or any(often(i, times) in weights for times in TIMES)
            )
            return known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = Weighted(), Model(weights, bias)
        for batch in batches:
            scores = [
                own.score(features(t, cache)) for t in text_column(batch, out[0])
            ]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1]
                + [
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)
