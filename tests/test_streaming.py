"""Streams against their batch twins, over several runs of one checkpoint."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scoring as sc
from tidewheel.operators import correlation as co
from tidewheel.schemas import MESSAGE_SCHEMA
from tidewheel.session import scratch_path, scratch_root, streaming_session
from tidewheel.sources import load, topics
from tidewheel.streaming import counts
from tidewheel.streaming import scoring as st
from tidewheel.streaming.correlation import replay_roundtrip
from tidewheel.streaming.runner import run_available

TIMEOUT = 300


def test_scratch_is_below_the_checkpoint_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.startswith(scratch_root(spark))
    assert named is None or path.startswith(named)
    assert path != scratch_path(spark, "x")


def test_the_callers_session_is_left_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    other = streaming_session(spark)
    assert "RocksDB" in other.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in spark.conf.get(
        "spark.sql.streaming.stateStore.providerClass", ""
    )
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_scored_stream_equals_batch(spark):
    session = streaming_session(spark)
    folder = scratch_path(spark, "t")
    m = sc.Model(
        np.array([0, 1]),
        np.ones(2),
        np.array([0.5, 0.5]),
        np.array([np.full(30, 0.45), np.full(30, 0.55)]),
        np.full((2, 30), 0.08),
    )
    stored = load.synthetic_load(spark.range(500), "id").select(
        F.when(F.col("id") % 50 == 0, F.lit("junk"))
        .otherwise(F.col("value"))
        .cast("binary")
        .alias("value"),
        F.array(
            F.struct(
                F.lit("correlationId").alias("key"),
                F.col("id").cast("string").cast("binary").alias("value"),
            )
        ).alias("headers"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )
    stored.repartition(3).write.parquet(f"{folder}/in")

    stream = topics.file_topic(session, f"{folder}/in", MESSAGE_SCHEMA, 1000)
    scored = st.observe_events(st.score_messages(stream, m))
    query = run_available(scored, f"{folder}/c", f"{folder}/out", timeout=TIMEOUT)

    progress = [dict(p.observedMetrics)["events"] for p in query.recentProgress if p.numInputRows]
    assert len(progress) > 1
    assert sum(p["received"] for p in progress) == 500
    assert sum(p["rejected"] for p in progress) == 10

    def rows(df):
        return sorted(
            (bytes(r["headers"][0]["value"]), r["result"], r["error"]) for r in df.collect()
        )

    out = spark.read.parquet(f"{folder}/out")
    assert rows(out) == rows(st.score_messages(spark.read.parquet(f"{folder}/in"), m))
    assert {r["result"] for r in out.select("result").distinct().collect()} == {True, False, None}


def test_counts_go_on_after_a_restart(spark):
    session = streaming_session(spark)
    folder = scratch_path(spark, "t")
    visits = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "page string")

    def arrive(df):
        df.write.mode("append").parquet(f"{folder}/visits")
        stream = topics.file_topic(session, f"{folder}/visits", visits.schema)
        counts.count_visits(stream, f"{folder}/c", timeout=TIMEOUT)
        return dict(counts.read_visits(session, f"{folder}/c").collect())

    assert arrive(visits) == {"a": 5, "b": 2}
    assert arrive(visits.where("page = 'a'")) == {"a": 10, "b": 2}
    assert arrive(visits.limit(0)) == {"a": 10, "b": 2}
    assert arrive(spark.createDataFrame([("c",)], "page string")) == {"a": 10, "b": 2, "c": 1}


@pytest.mark.parametrize("piece_rows,match_instance", [(10**9, True), (300, False)])
def test_streamed_roundtrip_equals_batch(spark, piece_rows, match_instance):
    session = streaming_session(spark)
    rng = random.Random(6)
    t0 = datetime(2024, 1, 1)
    requests, replies = [], []
    for i in range(300):
        sent = t0 + timedelta(seconds=rng.uniform(0, 3000))
        requests.append((f"c{i}", i % 3, sent))
        for _ in range(rng.choice([0, 1, 2, 3])):
            wait = rng.choice([-2, 0, 1, 14.999, 15, 31])
            replies.append(
                (f"c{i}", rng.choice([i % 3, 7]), rng.random() < 0.5, sent + timedelta(seconds=wait))
            )
    # Past any year a constant might stand for, and without a time.
    requests.append(("far", 1, datetime(2101, 1, 1)))
    replies.append(("far", 1, True, datetime(2101, 1, 1, 0, 0, 3)))
    requests.append(("timeless", 1, None))
    replies.append(("c1", 1, True, None))
    # A third of the replies belong to one request.
    requests.append(("hot", 1, t0))
    replies += [
        ("hot", 1, rng.random() < 0.5, t0 + timedelta(milliseconds=rng.randrange(1, 9000)))
        for _ in range(150)
    ]
    q = session.createDataFrame(requests, "cid string, inst bigint, ts timestamp")
    p = session.createDataFrame(
        replies, "cid string, inst bigint, result boolean, reply_ts timestamp"
    )
    out = replay_roundtrip(
        q,
        p,
        scratch_path(spark, "t"),
        piece_rows,
        timeout=TIMEOUT,
        match_instance=match_instance,
    )
    streamed = out.select("cid", "inst", "ok", "result", "wait_us")
    batch = co.reply_roundtrip(q, p, match_instance=match_instance).select(
        "cid",
        "inst",
        "ok",
        "result",
        (F.unix_micros("reply_ts") - F.unix_micros("ts")).alias("wait_us"),
    )
    key = lambda r: r["cid"]
    assert sorted(streamed.collect(), key=key) == sorted(batch.collect(), key=key)
