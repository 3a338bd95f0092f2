"""Scoring by a join on feature position, for models of any size.

The model stays a table (class_, pos, class_prior, theta, sigma) and never reaches the
driver. Vectors and parameters are cut into blocks of positions, so the join has one row
per vector, class and block rather than one per feature, and the scores of a vector's
blocks add up in tasks before they shuffle. Blocks of rows are dealt over ``spread``
copies of the model's block, so a model with few blocks still occupies many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.scoring import feature_array
from tidewheel.operators.training import model_rows

# Positions of a block.
BLOCK = 512


def model_blocks(model: DataFrame, block: int = BLOCK) -> DataFrame:
    """(class_, block, theta, weight, start): parameters of a class for a block of
    positions, and the part of its score that no feature enters."""
    rows = model.withColumn("block", F.floor(F.col("pos") / block).cast("int"))
    terms = F.struct("pos", "theta", (F.lit(-0.5) / _divisor("sigma")).alias("weight"))
    return (
        rows.groupBy("class_", "block")
        .agg(
            F.array_sort(F.collect_list(terms)).alias("terms"),
            F.sum(-0.5 * _log(2 * math.pi * F.col("sigma"))).alias("start"),
        )
        .select("class_", "block", "terms.theta", "terms.weight", "start")
    )


def _divisor(sigma: str) -> Column:
    """A variance that divides by IEEE rules: zero gives an infinity, not an error."""
    return F.when(F.col(sigma) == 0, F.lit(None)).otherwise(F.col(sigma))


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def nb_log_likelihood_long(
    rows: DataFrame,
    key: str,
    features,
    model: DataFrame,
    block: int = BLOCK,
    spread: int | None = None,
) -> DataFrame:
    """(key, class_, log_likelihood) of every row and class.

    ``key`` names a row; ``features`` is an array column or a list of columns, as in
    ``nb_log_likelihood``; ``model`` is a table of ``model_rows``. A missing feature counts
    as NaN. A row whose array has another length than the model does not come out.
    """
    spark = rows.sparkSession
    if spread is None:
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = model.agg(F.max("pos")).first()[0]
    width = 0 if width is None else width + 1
    x = feature_array(features).cast("array<double>")
    whole = rows.select(F.col(key).alias("_key"), x.alias("_x")).where(F.size("_x") == width)
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(max((width - 1) // block, 0))),
        lambda b: F.struct(b.alias("block"), F.slice("_x", b * block + 1, F.lit(block)).alias("x")),
    )
    parts = whole.select(
        "_key",
        F.pmod(F.xxhash64("_key"), F.lit(spread)).cast("int").alias("copy"),
        F.explode(cut).alias("p"),
    ).select("_key", "copy", "p.block", "p.x")
    copies = model_blocks(model, block).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    )
    nan = F.lit(float("nan"))

    def term(x: Column, p: Column) -> Column:
        gap = F.coalesce(x, nan) - p["theta"]
        # Without a variance the gap's square over zero is infinite, or NaN at the mean.
        over = F.when(gap == 0, nan).otherwise(F.lit(float("-inf")))
        return F.when(p["weight"].isNull(), over).otherwise(gap * gap * p["weight"])

    terms = F.zip_with("x", F.arrays_zip("theta", "weight"), term)
    partial = F.aggregate(terms, F.col("start"), lambda a, v: a + v)
    met = parts.join(copies, ["block", "copy"])
    scores = met.select("_key", "class_", partial.alias("_partial"))
    return scores.groupBy(F.col("_key").alias(key), "class_").agg(
        F.sum("_partial").alias("log_likelihood")
    )


def nb_predict_long(
    rows: DataFrame, key: str, features, model: DataFrame, **options
) -> DataFrame:
    """(key, predicted, positive) of every row, by the rules of ``nb_argmax``: a tie goes
    to the first class, and so does a score that is NaN or no better than minus infinity.
    Both are NULL for a row of another length than the model."""
    priors = model.groupBy("class_").agg(_log(F.first("class_prior")).alias("log_prior"))
    likelihood = nb_log_likelihood_long(rows, key, features, model, **options)
    joint = likelihood.join(priors, "class_").withColumn(
        "joint", F.col("log_likelihood") + F.col("log_prior")
    )
    best = joint.groupBy(key).agg(
        F.max(F.struct("joint", (-F.col("class_")).alias("back"))).alias("best"),
        F.min("class_").alias("first"),
    )
    undecided = F.isnan("best.joint") | (F.col("best.joint") == float("-inf"))
    chosen = best.select(
        key, F.when(undecided, F.col("first")).otherwise(-F.col("best.back")).alias("predicted")
    )
    return (
        rows.select(key)
        .join(chosen, key, "left")
        .withColumn("positive", F.col("predicted") == 1)
    )


def stored_model_rows(record: DataFrame) -> DataFrame:
    """The rows of a stored record, as ``nb_predict_long`` takes them."""
    return model_rows(record).drop("class_count")
