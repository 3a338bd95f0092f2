"""Message topics: (value, headers, timestamp), each message once, in one contract for
all that write and read them.

``brokers`` says where a topic lives: Kafka's bootstrap servers, or ``folder:`` and a path,
below which every topic is a folder of parquet files. A folder is a topic for replays,
tests and stored tables; its messages carry the time they were landed, as a broker would
note it, unless they bring a time of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidewheel.functions.headers import correlation_headers
from tidewheel.functions.payloads import json_payload
from tidewheel.schemas import HEADERS_TYPE, MESSAGE_SCHEMA
from tidewheel.streaming.runner import run_available

FOLDER = "folder:"


def topic_folder(brokers: str, topic: str) -> str | None:
    """Where a folder topic lies; None for Kafka's."""
    if not brokers.startswith(FOLDER):
        return None
    return f"{brokers.removeprefix(FOLDER).rstrip('/')}/{topic}"


def as_messages(rows: DataFrame) -> DataFrame:
    """Rows in the contract: ``value`` as bytes, ``headers``, none if there is no such
    column, and ``timestamp``, the present one if there is none."""

    def column(name: str, kind: T.DataType, default: Column) -> Column:
        found = F.col(name) if name in rows.columns else default
        return found.cast(kind).alias(name)

    return rows.select(
        column("value", T.BinaryType(), F.lit(None)),
        column("headers", HEADERS_TYPE, F.array()),
        F.coalesce(
            column("timestamp", T.TimestampType(), F.lit(None)), F.current_timestamp()
        ).alias("timestamp"),
    )


def topic_source(
    spark: SparkSession,
    brokers: str,
    topic: str,
    from_beginning: bool = True,
    max_offsets_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Subscribe to a topic. Each query keeps its own position in its checkpoint, so
    every instance that runs one sees all messages.

    A query that should not see what is there already starts at the end: Kafka fixes that
    position by itself when it runs first, a folder by ``start_from_latest``.
    """
    folder = topic_folder(brokers, topic)
    if folder is not None:
        if not from_beginning:
            raise ValueError("fix a folder's start with start_from_latest")
        return file_topic(spark, folder, MESSAGE_SCHEMA, max_bytes_per_trigger)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .option("startingOffsets", "earliest" if from_beginning else "latest")
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select("value", "headers", "timestamp")


def topic_sink(
    messages: DataFrame, brokers: str, topic: str, checkpoint: str
) -> DataStreamWriter:
    """Writer that sends a stream's messages to a topic. A folder gets every message
    exactly once; Kafka at least once, with a broker's own timestamp."""
    sent = as_messages(messages)
    folder = topic_folder(brokers, topic)
    if folder is not None:
        writer = sent.writeStream.format("parquet").option("path", folder)
    else:
        writer = (
            sent.select("value", "headers")
            .writeStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("topic", topic)
            .option("includeHeaders", "true")
        )
    return writer.option("checkpointLocation", checkpoint)


def land_messages(messages: DataFrame, brokers: str, topic: str) -> None:
    """Send a table's messages to a topic, adding to what is there."""
    sent = as_messages(messages)
    folder = topic_folder(brokers, topic)
    if folder is not None:
        sent.write.mode("append").parquet(folder)
        return
    (
        sent.select("value", "headers")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .option("includeHeaders", "true")
        .save()
    )


def topic_table(spark: SparkSession, brokers: str, topic: str) -> DataFrame:
    """All messages of a topic as a table."""
    folder = topic_folder(brokers, topic)
    if folder is not None:
        return spark.read.schema(MESSAGE_SCHEMA).parquet(folder)
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", brokers)
    reader = reader.option("subscribe", topic).option("includeHeaders", "true")
    return reader.load().select("value", "headers", "timestamp")


def start_from_latest(
    stream: DataFrame, checkpoint: str, path: str | None = None, timeout: float | None = None
) -> None:
    """Fix the start of a query over ``stream`` that has not run yet at the end of what
    its folders hold; one that has run goes on where it is.

    The position is the checkpoint's own: its first micro-batch takes all files there are
    and reads none of them. Run the query with the same checkpoint afterwards, and if it
    writes files, name their ``path`` here too: a file sink counts its batches.
    """
    try:
        stream.sparkSession.read.text(f"{checkpoint}/commits").limit(1).collect()
    except AnalysisException:
        run_available(stream.where(F.lit(False)), checkpoint, path, timeout=timeout)


def file_topic(
    spark: SparkSession,
    path: str,
    schema: T.StructType = MESSAGE_SCHEMA,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of a folder or table of parquet files, new ones as they arrive."""
    reader = spark.readStream.schema(schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.parquet(path)


def request_producer(
    records: DataFrame,
    fields: Sequence[str],
    correlation_id: Column,
    instance_id: Column,
    *keep: str,
) -> DataFrame:
    """Records as messages: fields as a JSON object, ids as headers."""
    return records.select(
        *keep,
        json_payload(fields).cast("binary").alias("value"),
        correlation_headers(correlation_id, instance_id).alias("headers"),
    )


def results_from_latest(
    results: DataFrame, started: str | Column, timestamp: str = "timestamp"
) -> DataFrame:
    """What a consumer that joined at ``started`` sees of a stored topic."""
    start = F.lit(started) if isinstance(started, str) else started
    return results.where(F.col(timestamp) > start)
