"""Matching replies to requests on live streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.clock import epoch_micros
from tidewheel.operators.correlation import correlation_keys
from tidewheel.schemas import REPLY_TIMEOUT_SECONDS
from tidewheel.sources.topics import file_topic
from tidewheel.streaming.runner import run_available

# Rows of both sides that one run of a replay takes, and its state holds at most.
PIECE_ROWS = 200_000_000


def reply_roundtrip_stream(
    requests: DataFrame,
    replies: DataFrame,
    timeout_seconds: float = REPLY_TIMEOUT_SECONDS,
    lateness: str = "10 seconds",
    match_instance: bool = True,
) -> DataFrame:
    """Every request (cid, inst, ts) once, with ``ok``, ``result`` and ``wait_us``.

    Rows meet by id and by a slot of time as long as the time-out, requests being in
    their own slot and the next, so a busy id spreads over tasks as time goes on.

    A request comes out once the watermark has passed its time-out, and its state
    goes with it. The last step keeps the earliest reply, so what is kept does not
    depend on how replies fall into micro-batches. A request without a time has no
    place on a watermark and does not come out.
    """
    width = F.lit(int(timeout_seconds * 1_000_000))

    def slot(rows: DataFrame, at: str):
        return F.floor(epoch_micros(rows, at) / width).cast("bigint")

    own = slot(requests, "ts")
    asked = (
        requests.select("cid", "inst", "ts", F.explode(F.array(own, own + 1)).alias("slot"))
        .withWatermark("ts", lateness)
        .alias("q")
    )
    answers = (
        replies.where(F.coalesce(F.col("cid").cast("string"), F.lit("")) != "")
        .select("cid", "inst", "reply_ts", "result", slot(replies, "reply_ts").alias("slot"))
        .withWatermark("reply_ts", lateness)
        .alias("p")
    )
    in_time = (
        (F.col("q.cid") == F.col("p.cid"))
        & (F.col("q.slot") == F.col("p.slot"))
        & (F.col("p.reply_ts") >= F.col("q.ts"))
        & (
            F.col("p.reply_ts")
            < F.col("q.ts") + F.lit(timedelta(seconds=timeout_seconds))
        )
    )
    if match_instance:
        in_time &= F.col("q.inst") == F.col("p.inst")
    # Only one event-time column may go on, so the reply's time becomes a number.
    matched = asked.join(answers, in_time, "leftOuter").select(
        "q.cid",
        "q.inst",
        "q.ts",
        F.when(
            F.col("p.reply_ts").isNotNull(),
            F.struct(F.unix_micros("p.reply_ts").alias("at"), F.col("p.result")),
        ).alias("reply"),
    )
    return (
        matched.groupBy("cid", "inst", "ts")
        .agg(F.min("reply").alias("reply"))
        .select(
            "cid",
            "inst",
            "ts",
            F.col("reply").isNotNull().alias("ok"),
            F.col("reply.result").alias("result"),
            (F.col("reply.at") - F.unix_micros("ts")).alias("wait_us"),
        )
    )


def time_cuts(rows: DataFrame, at: str, pieces: int) -> list[datetime]:
    """Times that cut the rows into pieces of about equally many."""
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    (cuts,) = rows.agg(F.percentile_approx(at, shares, 100 * pieces)).first()
    return sorted(set(cuts or []))


def arrivals(
    sides: Sequence[tuple[DataFrame, str, str]],
    times: DataFrame,
    rows: int,
    piece_rows: int,
) -> Iterator[None]:
    """Write the sides (rows, their time, folder) in time order, about ``piece_rows`` of
    the ``rows`` of ``times`` (ts) each time; rows without a time stay out."""
    cuts = time_cuts(times, "ts", -(-rows // piece_rows))
    for low, high in zip([None, *cuts], [*cuts, None]):
        for side, at, path in sides:
            piece = side.where(F.col(at).isNotNull())
            if low is not None:
                piece = piece.where(F.col(at) >= F.lit(low))
            if high is not None:
                piece = piece.where(F.col(at) < F.lit(high))
            piece.write.mode("append").parquet(path)
        yield


def replay_roundtrip(
    requests: DataFrame,
    replies: DataFrame,
    folder: str,
    piece_rows: int = PIECE_ROWS,
    timeout: float | None = None,
    match_instance: bool = True,
    timeout_seconds: float = REPLY_TIMEOUT_SECONDS,
    lateness: str = "10 seconds",
) -> DataFrame:
    """Run the round trip over stored streams to the end; returns its output.

    The stored rows arrive in time order in pieces of about ``piece_rows`` rows, so
    state holds about one piece and no row comes late. The last requests would wait for
    a watermark that never comes, so one marker on each side follows whose time lies
    past the last request's time-out and the lateness. The watermark passes every
    request but not the markers, so they stay out of the output. A marker has an id:
    Spark drops rows without one before it looks at their times. Requests without a
    time need no stream: they are unanswered and are added at the end.
    """
    session = requests.sparkSession
    out, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    sides = (
        (requests.select("cid", "inst", "ts"), "ts", f"{folder}/requests"),
        (
            replies.select("cid", "inst", "result", "reply_ts"),
            "reply_ts",
            f"{folder}/replies",
        ),
    )
    times = sides[0][0].select("ts").unionByName(
        sides[1][0].select(F.col("reply_ts").alias("ts"))
    )
    rows, last = times.agg(F.count("ts"), F.max("ts")).first()

    def run() -> None:
        asked, answered = (
            file_topic(session, path, side.schema) for side, _, path in sides
        )
        run_available(
            reply_roundtrip_stream(
                asked, answered, timeout_seconds, lateness, match_instance
            ),
            checkpoint,
            out,
            timeout=timeout,
        )

    for _ in arrivals(sides, times, rows, piece_rows):
        run()

    # Past the time-out of the last request, the lateness, and the slots' width.
    ahead = F.lit(last) + F.expr(f"INTERVAL {2 * timeout_seconds + 1} SECONDS")
    ahead = ahead + F.expr(f"2 * INTERVAL {lateness}") if last else ahead
    for side, at, path in sides if last else ():
        marker = {"cid": F.lit("marker"), at: ahead}
        session.range(1).select(
            *[
                marker.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name)
                for f in side.schema
            ]
        ).write.mode("append").parquet(path)
    if last:
        run()
    timeless = sides[0][0].where("ts is null").withColumns(
        {
            "ok": F.lit(False),
            "result": F.lit(None).cast(replies.schema["result"].dataType),
            "wait_us": F.lit(None).cast("bigint"),
        }
    )
    found = session.read.schema(timeless.schema).parquet(out)
    return found.unionByName(timeless)
