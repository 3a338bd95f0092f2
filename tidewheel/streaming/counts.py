"""Visit counts that survive restarts: the count is a streaming aggregate, and its
state in the checkpoint folder is the one durable copy. Visits that are to be told their
own number are numbered micro-batch by micro-batch, on top of each page's counter."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewheel.operators.counters import visit_count, visit_number
from tidewheel.streaming.runner import batchwise, run_available


def count_visits(
    visits: DataFrame, checkpoint: str, page: str = "page", timeout: float | None = None
) -> None:
    """Count all visits that arrived since the last run with this checkpoint.

    Each visit is counted exactly once, also if a run dies half way. Tasks add up
    their own visits first, so a busy page sends one row per task.
    """
    run_available(
        visit_count(visits, page), checkpoint, output_mode="update", timeout=timeout
    )


def read_visits(session: SparkSession, checkpoint: str, page: str = "page") -> DataFrame:
    """Current counts, read from the state itself, in parallel."""
    return (
        session.read.format("statestore")
        .load(checkpoint)
        .select(F.col(f"key.{page}").alias(page), F.col("value.count").alias("visits"))
    )


def number_visits(
    visits: DataFrame, folder: str, page: str = "page", order: Sequence[str] = ("ts",)
) -> DataStreamWriter:
    """Writer that gives every arriving visit the counter value after its own increment;
    ``numbered_visits`` reads them.

    Visits are numbered in the order of arrival, those of one micro-batch by ``order``,
    which must be unique within a page. The counters of all pages after a micro-batch are
    kept below its number, which only the next one reads: a batch that comes again finds
    the same counters and replaces what it wrote. A page's visits of a batch are spread
    over tasks; its counter joins one row per page and slice, not the visits.
    """
    kept = visits.select(page).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            totals = spark.read.schema(f"{kept.replace(':', ' ')}, visits bigint")
            before = totals.parquet(f"{folder}/counters/{batch_id - 1}")
        slices = f"{folder}/slices/{batch_id}-{uuid.uuid4().hex}"
        numbered = visit_number(batch, slices, page, order, before=before)
        numbered.write.mode("overwrite").parquet(f"{folder}/numbered/batch={batch_id}")
        counted = visit_count(spark.read.parquet(slices), page)
        if before is not None:
            both = counted.unionByName(before)
            counted = both.groupBy(page).agg(F.sum("visits").alias("visits"))
        counted.write.mode("overwrite").parquet(f"{folder}/counters/{batch_id}")

    return batchwise(visits, number, f"{folder}/checkpoint")


def numbered_visits(session: SparkSession, folder: str) -> DataFrame:
    return session.read.parquet(f"{folder}/numbered").drop("batch")
