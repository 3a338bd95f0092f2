"""The trained model as one JSON document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.schemas import MODEL_SCHEMA

VERSIONED = T.StructType([*MODEL_SCHEMA.fields, T.StructField("version", T.LongType())])


def model_json_write(
    model: DataFrame, path: str, options: Mapping[str, str] | None = None
) -> None:
    """``model`` is a single row, so one file is all there is to write."""
    writer = model.coalesce(1).write.options(**dict(options or {}))
    writer.mode("overwrite").json(path)


def model_json_read(
    spark: SparkSession, path: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    return spark.read.options(**dict(options or {})).schema(MODEL_SCHEMA).json(path)


def publish_model(
    model: DataFrame, root: str, options: Mapping[str, str] | None = None
) -> int:
    """Store ``model`` as the next version below ``root``; earlier ones stay as they are.
    Readers see a version once all of it is there. One writer at a time."""
    spark = model.sparkSession
    try:
        known = _versions(spark, root, options).agg(F.max("version")).first()[0]
    except AnalysisException:
        known = None
    version = (known or 0) + 1
    model_json_write(model, f"{root}/version={version}", options)
    return version


def latest_model(
    spark: SparkSession, root: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """The record of the newest version, as of now."""
    newest = _versions(spark, root, options).agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"no model at {root}")
    return model_json_read(spark, f"{root}/version={newest}", options)


def _versions(spark, root, options) -> DataFrame:
    reader = spark.read.options(**dict(options or {})).schema(VERSIONED)
    return reader.json(root).select("version")
