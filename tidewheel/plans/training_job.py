"""The whole training run: raw file in, stored model out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidewheel.operators.training import drop_column, labelled_rows, nb_model
from tidewheel.schemas import FEATURE_COLUMNS, ID_COLUMN, LABEL_COLUMN
from tidewheel.sources.lake import csv_named_scan
from tidewheel.sources.model_store import model_json_read, model_json_write


def train_from_csv(
    spark: SparkSession,
    csv_path: str,
    model_path: str,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Train on a headerless file, store the model and return the stored record; all
    reading and writing with the store ``options``."""
    rows = drop_column(csv_named_scan(spark, csv_path, options=options), ID_COLUMN)
    rows = labelled_rows(rows, LABEL_COLUMN)
    model_json_write(nb_model(rows, FEATURE_COLUMNS), model_path, options)
    return model_json_read(spark, model_path, options)
