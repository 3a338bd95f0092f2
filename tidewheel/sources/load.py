"""Synthetic load: JSON messages with uniform random features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.schemas import FORM_FIELDS, LOAD_FIELDS

# Fixed value: nominal messages per second of the load generator.
ROWS_PER_SECOND = 1000


# Fields drawn from one digest: it has 64 hexadecimal digits, 13 for each field.
FIELDS_PER_DIGEST = 4


def uniform(key: Column, field: int, seed: int = 0) -> Column:
    """A double in [0, 1): 52 bits of the SHA-256 of key, digest and seed, which serves
    four fields.

    Unlike ``rand`` it does not depend on how rows are split into tasks, so a task
    that runs again sends the same messages.
    """
    return _bits(_digest(key, field // FIELDS_PER_DIGEST, seed), field)


def _digest(key: Column, number: int, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(number), F.lit(seed)), 256)


def _bits(digest: Column, field: int) -> Column:
    start = 1 + 13 * (field % FIELDS_PER_DIGEST)
    bits = F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint")
    return bits.cast("double") * F.lit(2.0**-52)


def _drawn(
    rows: DataFrame, key: str, fields: Sequence[str], seed: int, form: Callable
) -> DataFrame:
    """(key, value): the fields as a JSON object, each digest worked out once a row."""
    digests = {
        f"_digest{i}": _digest(F.col(key), i, seed)
        for i in range(-(-len(fields) // FIELDS_PER_DIGEST))
    }
    named = [
        form(_bits(F.col(f"_digest{i // FIELDS_PER_DIGEST}"), i)).alias(f)
        for i, f in enumerate(fields)
    ]
    drawn = rows.select(key).withColumns(digests)
    return drawn.select(key, F.to_json(F.struct(*named)).alias("value"))


def synthetic_load(
    rows: DataFrame, key: str, fields: Sequence[str] = LOAD_FIELDS, seed: int = 0
) -> DataFrame:
    """One message per row, as JSON numbers."""
    return _drawn(rows, key, fields, seed, lambda x: x)


def synthetic_load_stream(
    spark: SparkSession, rows_per_second: int = ROWS_PER_SECOND, seed: int = 0
) -> DataFrame:
    """Endless load at a steady rate."""
    ticks = (
        spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    )
    return synthetic_load(ticks.withColumnRenamed("value", "tick"), "tick", seed=seed)


def form_random_fill(
    rows: DataFrame, key: str, fields: Sequence[str] = FORM_FIELDS, seed: int = 0
) -> DataFrame:
    """One filled-in form per row: values as texts with two digits."""
    return _drawn(rows, key, fields, seed, lambda x: F.format_string("%.2f", x))
