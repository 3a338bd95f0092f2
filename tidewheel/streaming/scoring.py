"""Scoring a stream of messages with a stored model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewheel.functions.headers import header_decode, header_forward
from tidewheel.functions.payloads import feature_error, feature_map, numbers
from tidewheel.functions.scoring import Model, load_model, nb_predict_batch
from tidewheel.sources.model_store import latest_model
from tidewheel.streaming.runner import batchwise


def score_messages(messages: DataFrame, model: Model, form: str = "auto") -> DataFrame:
    """One scored row per message: its columns, then ``result``, ``error`` and
    ``out_headers``. Map-only, for tables and streams alike.

    A message that cannot be scored has a NULL result and says why in ``error``; the
    others go on.
    """
    parsed = messages.withColumn("_m", feature_map("value")).withColumn(
        "_x", numbers(F.map_values("_m"), "value")
    )
    parsed = parsed.withColumn(
        "error", feature_error(F.map_keys("_m"), "_x", model.n_features)
    )
    scorable = F.when(F.col("error").isNull(), F.col("_x"))
    scored = nb_predict_batch(
        parsed.withColumn("_x", scorable), "_x", model, form, "_class", "result"
    )
    return scored.withColumn("out_headers", header_forward("headers")).drop(
        "_m", "_x", "_class"
    )


def score_with_latest(
    messages: DataFrame, models: str, folder: str, form: str = "auto"
) -> DataStreamWriter:
    """Writer that scores each micro-batch of ``messages`` with the newest model
    published below ``models`` when the batch starts; ``scored_messages`` reads the rows.

    The record is fetched once a batch, after a check of its size, and scoring stays
    map-only. A batch that comes again replaces its rows, scored by the then newest model.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        model = load_model(latest_model(batch.sparkSession, models))
        scored = score_messages(batch, model, form)
        scored.write.mode("overwrite").parquet(f"{folder}/scored/batch={batch_id}")

    return batchwise(messages, score, f"{folder}/checkpoint")


def scored_messages(session: SparkSession, folder: str) -> DataFrame:
    return session.read.parquet(f"{folder}/scored").drop("batch")


def observe_events(scored: DataFrame, name: str = "events") -> DataFrame:
    """The same rows, with their counts reported in the query's progress: what to
    watch where a line per event is too much."""
    return scored.observe(
        name,
        F.count(F.lit(1)).alias("received"),
        F.count("result").alias("scored"),
        F.count("error").alias("rejected"),
        F.count_if(F.col("result")).alias("positive"),
    )


def result_messages(scored: DataFrame, *keep: str, name: str = "results") -> DataFrame:
    """Scored rows as result messages: a JSON boolean and the forwarded headers.

    Rows are counted before they are filtered. The count also keeps the filter where
    it is; moved down to the scan it would parse every message once more per use.
    """
    return (
        observe_events(scored, name)
        .where(F.col("error").isNull())
        .select(
            *keep,
            F.col("result").cast("string").cast("binary").alias("value"),
            F.col("out_headers").alias("headers"),
        )
    )


def rejected_messages(scored: DataFrame, name: str = "rejected") -> DataFrame:
    """Messages that could not be scored, with the reason."""
    return (
        observe_events(scored, name)
        .where(F.col("error").isNotNull())
        .drop("result", "out_headers")
    )


def _headers_text(headers: str) -> Column:
    pairs = F.transform(
        header_decode(headers),
        lambda h: F.concat(h["key"], F.lit("="), F.coalesce(h["value"], F.lit("null"))),
    )
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def event_log(scored: DataFrame, *keep: str) -> DataFrame:
    """One line per event: what came in, with which headers, and what goes out."""
    return scored.select(
        *keep,
        F.concat_ws(
            " ",
            F.concat(F.lit("in="), F.col("value").cast("string")),
            F.concat(F.lit("headers=["), _headers_text("headers"), F.lit("]")),
            F.concat(
                F.lit("out="),
                F.coalesce(F.col("result").cast("string"), F.col("error")),
            ),
            F.concat(F.lit("to=["), _headers_text("out_headers"), F.lit("]")),
        ).alias("line"),
    )
