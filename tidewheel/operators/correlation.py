"""Matching replies to requests.

Requests have the columns ``cid``, ``inst``, ``ts`` and any others; replies have
``cid``, ``inst``, ``result`` and ``reply_ts``. A correlation id names one request.
A reply counts if it arrives at or after the request and before the time-out.

Time is cut into slots of the time-out's length, for every id alike, and rows meet by
id and slot. A row of one side goes to the two slots it can matter in. For the first
reply of each request both sides are tagged, put together and sorted by time within id
and slot, so one running value answers every row and no pairs are built; replies of one
instant are merged before, so an id has a bounded number of them in a slot.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.clock import epoch_micros
from tidewheel.schemas import REPLY_TIMEOUT_SECONDS


def route_filter(results: DataFrame, instance_id, cid="cid", inst="inst") -> DataFrame:
    """Results that carry a correlation id and are meant for this instance."""
    return results.where(_usable(cid) & (F.col(inst) == F.lit(instance_id)))


def single_reply_filter(results: DataFrame, correlation_id, cid="cid") -> DataFrame:
    return results.where(F.col(cid) == F.lit(correlation_id))


def _usable(cid: str) -> Column:
    """An id that is neither missing nor empty."""
    return F.coalesce(F.col(cid).cast("string"), F.lit("")) != ""


def correlation_keys(match_instance: bool) -> list[str]:
    return ["cid", "inst"] if match_instance else ["cid"]


def _timeout(seconds: float) -> Column:
    return F.lit(timedelta(seconds=seconds))


def _slot(df: DataFrame, at: str, seconds: float) -> Column:
    width = F.lit(int(seconds * 1_000_000))
    return F.floor(epoch_micros(df, at) / width).cast("bigint")


def _usable_replies(replies: DataFrame, match_instance: bool) -> DataFrame:
    usable = replies.where(_usable("cid"))
    return usable.where(F.col("inst").isNotNull()) if match_instance else usable


def _prepare(requests, replies, timeout_seconds, match_instance):
    """Tag both sides and put them together as (keys, slot, at, request, reply); a
    reply is in its own slot and in the one before."""
    keys = correlation_keys(match_instance)
    request = F.struct(*[F.col(c) for c in requests.columns])
    # A request without an id or a time meets no reply; any slot does.
    lone = F.pmod(F.xxhash64(request), F.lit(1 << 20))
    own = F.coalesce(_slot(requests, "ts", timeout_seconds), lone)
    asked = requests.select(
        *keys,
        F.when(_usable("cid"), own).otherwise(lone).alias("slot"),
        F.col("ts").alias("at"),
        request.alias("request"),
    )
    # Of replies at one instant the smallest result counts, a missing one first.
    usable = _usable_replies(replies, match_instance)
    merged = usable.groupBy(*keys, "reply_ts").agg(
        F.min(F.struct("result")).alias("least")
    )
    slot = _slot(merged, "reply_ts", timeout_seconds)
    answers = merged.select(
        *keys,
        F.explode(F.array(slot, slot - 1)).alias("slot"),
        F.col("reply_ts").alias("at"),
        F.struct("reply_ts", "least.result").alias("reply"),
    )
    return asked.unionByName(answers, allowMissingColumns=True), keys


def reply_roundtrip(
    requests: DataFrame,
    replies: DataFrame,
    timeout_seconds: float = REPLY_TIMEOUT_SECONDS,
    match_instance: bool = True,
) -> DataFrame:
    """Every request once, with ``ok``, and ``reply_ts`` and ``result`` of the first
    reply in time; both NULL if the request timed out."""
    rows, keys = _prepare(requests, replies, timeout_seconds, match_instance)
    # Latest first, so the last reply seen so far is the next one in time.
    backwards = (
        Window.partitionBy(*keys, "slot")
        .orderBy(F.desc("at"), F.col("request").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    following = (
        rows.withColumn("reply", F.last("reply", ignorenulls=True).over(backwards))
        .where(F.col("request").isNotNull())
        .withColumn(
            "ok",
            F.coalesce(
                F.col("reply.reply_ts") < F.col("at") + _timeout(timeout_seconds),
                F.lit(False),
            ),
        )
    )
    return following.select(
        "request.*",
        "ok",
        F.when(F.col("ok"), F.col("reply.reply_ts")).alias("reply_ts"),
        F.when(F.col("ok"), F.col("reply.result")).alias("result"),
    )


def reply_match(
    requests: DataFrame,
    replies: DataFrame,
    timeout_seconds: float = REPLY_TIMEOUT_SECONDS,
    match_instance: bool = True,
) -> DataFrame:
    """Every reply that arrives in time, next to its request; others are ignored.

    A join by id and slot, requests being in their own slot and the next: Spark splits
    the replies of a busy id and slot, as a request is one row there.
    """
    keys = correlation_keys(match_instance)
    slot = _slot(requests, "ts", timeout_seconds)
    asked = requests.where(_usable("cid")).select(
        F.struct(*[F.col(c) for c in requests.columns]).alias("request"),
        *[F.col(k).alias(f"asked_{k}") for k in keys],
        F.explode(F.array(slot, slot + 1)).alias("asked_slot"),
    )
    usable = _usable_replies(replies, match_instance)
    answers = usable.select(
        *[F.col(k).alias(f"own_{k}") for k in keys],
        _slot(usable, "reply_ts", timeout_seconds).alias("own_slot"),
        "reply_ts",
        "result",
    )
    met = F.col("asked_slot") == F.col("own_slot")
    for key in keys:
        met &= F.col(f"asked_{key}") == F.col(f"own_{key}")
    in_time = (F.col("reply_ts") >= F.col("request.ts")) & (
        F.col("reply_ts") < F.col("request.ts") + _timeout(timeout_seconds)
    )
    matched = answers.join(asked, met).where(in_time)
    return matched.select("request.*", "reply_ts", "result")


def reply_timeouts(requests: DataFrame, replies: DataFrame, **options) -> DataFrame:
    """Requests without a reply in time."""
    outcome = reply_roundtrip(requests, replies, **options)
    return outcome.where(~F.col("ok")).select(*requests.columns)


def reply_first_wins(requests: DataFrame, replies: DataFrame, **options) -> DataFrame:
    """The reply that settled each answered request."""
    return reply_roundtrip(requests, replies, **options).where("ok").drop("ok")


def topic_backlog(
    requests: DataFrame, results: DataFrame, bucket: Column, cid: str = "cid"
) -> DataFrame:
    """Requests no result exists for, counted per time bucket.

    Results shrink to their distinct ids first, which merges repeats before the
    shuffle and leaves the join nothing to repeat.
    """
    named = requests.where(F.col(cid).isNotNull())
    waiting = named.join(results.select(cid).distinct(), cid, "left_anti")
    # Requests without an id have no result and need no join, which would gather them.
    nameless = requests.where(F.col(cid).isNull())
    every = waiting.select(bucket.alias("bucket")).unionByName(
        nameless.select(bucket.alias("bucket"))
    )
    return every.groupBy("bucket").agg(F.count(F.lit(1)).alias("backlog"))
