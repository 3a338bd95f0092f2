"""Visit counts as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bits of a row's number within its task in Spark's increasing ids.
_ROW_BITS = (1 << 33) - 1


def visit_count(visits: DataFrame, page: str = "page") -> DataFrame:
    return visits.groupBy(page).agg(F.count(F.lit(1)).alias("visits"))


def visit_number(
    visits: DataFrame,
    folder: str,
    page: str = "page",
    order: Sequence[str] = ("ts",),
    slices: int | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """Each visit with the counter value after its own increment, on top of what the
    counters stood at ``before`` (page, visits), zero if nothing is said.

    ``order`` must be unique within a page. The visits are cut into ``slices`` by page
    and order, so a page of any size spreads over many of them, sorted, and written to
    ``folder``, a new path that all executors reach, with their place in the slice: all
    readers see one cut even if tasks run again. A visit's number is its place, less
    that of its page's first visit there, plus what earlier slices hold of the page.
    """
    spark = visits.sparkSession
    if slices is None:
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        visits.repartitionByRange(slices, page, *order)
        .sortWithinPartitions(page, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn(
            "_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        )
        .write.parquet(folder)
    )
    sliced = spark.read.parquet(folder)
    # One row per page and slice; most pages lie in one slice.
    upto = (
        Window.partitionBy("_page")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = (
        sliced.groupBy(F.col(page).alias("_page"), F.col("_slice").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    )
    if before is not None:
        stood = before.select(F.col(page).alias("_known"), F.col("visits").alias("_stood"))
        same = F.col("_page").eqNullSafe(F.col("_known"))
        counted = F.col("_before") + F.coalesce("_stood", F.lit(0))
        starts = starts.join(stood, same, "left").withColumn("_before", counted)
    met = F.col(page).eqNullSafe(F.col("_page")) & (F.col("_slice") == F.col("_at"))
    number = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return sliced.join(starts, met).select(
        *visits.columns, number.cast("bigint").alias("visit")
    )
