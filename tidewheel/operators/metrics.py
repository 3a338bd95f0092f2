"""Metric samples: columns name, labels map<string,string>, ts, value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_latest(
    samples: DataFrame, name: str | None = None, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Current value of every series, or of those with this name and these labels.

    Of samples at one instant the greatest value counts. Tasks send one row per
    series, so a busy series costs no more than a quiet one.
    """
    chosen = samples
    if name is not None:
        chosen = chosen.where(F.col("name") == name)
    for key, value in (labels or {}).items():
        chosen = chosen.where(F.col("labels").getItem(key) == value)
    series = F.array_sort(F.map_entries("labels"))
    return (
        chosen.groupBy("name", series.alias("series"))
        .agg(F.max(F.struct("ts", "value")).alias("last"))
        .select(
            "name", F.map_from_entries("series").alias("labels"), "last.ts", "last.value"
        )
    )
