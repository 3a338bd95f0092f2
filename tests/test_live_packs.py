"""Live outcomes whose ids share keys of state: same rows, few keys."""

import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_live import REPLY, REQUEST, T0, TIMEOUT, batch_outcomes, outcomes, sides

from tidewheel.plans.queries import QUERIES
from tidewheel.session import scratch_path, scratch_root, streaming_session
from tidewheel.sources import topics
from tidewheel.streaming import pending


@pytest.fixture
def session(spark):
    return streaming_session(spark)


@pytest.fixture
def folder(spark):
    return scratch_path(spark, "t")


def keys(session, checkpoint, batch=0):
    """Keys that hold requests or replies after a micro-batch."""
    found = set()
    for name in ("requests", "replies"):
        reader = session.read.format("statestore").option("stateVarName", name)
        rows = reader.option("batchId", batch).load(checkpoint)
        found |= {tuple(r.key) for r in rows.select("key").collect()}
    return found


@pytest.mark.parametrize(
    "piece_rows,match_instance,held", [(10**9, True, 10_000), (300, True, 7), (300, False, 5)]
)
def test_packed_outcomes_equal_batch(
    session, folder, monkeypatch, piece_rows, match_instance, held
):
    monkeypatch.setattr(pending, "HELD", held)
    q, p = sides(session)
    if not match_instance:
        q = q.where("cid is null or cid <> 'lost'")
    out = pending.replay_outcomes(
        q,
        p,
        folder,
        piece_rows,
        timeout=TIMEOUT,
        pack_rows=20,
        match_instance=match_instance,
    )
    assert outcomes(out) == batch_outcomes(q, p, match_instance=match_instance)


def test_many_ids_make_few_keys(session, folder):
    at = F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 400)
    ids = session.range(2000).select(F.col("id").cast("string").alias("cid"), "id", at.alias("at"))
    q = ids.select("cid", F.lit(1).cast("bigint").alias("inst"), F.col("at").alias("ts"))
    p = ids.select(
        "cid",
        F.lit(1).cast("bigint").alias("inst"),
        (F.col("id") % 2 == 0).alias("result"),
        (F.col("at") + F.make_dt_interval(secs=F.col("id") % 30)).alias("reply_ts"),
    )
    out = pending.replay_outcomes(q, p, folder, timeout=TIMEOUT, pack_rows=1000)
    assert outcomes(out) == batch_outcomes(q, p)
    # Two packs in four slots at most, and one that early replies are sent back to.
    assert 0 < len(keys(session, f"{folder}/checkpoint")) <= 2 * 5


def test_ids_that_are_numbers(session, folder):
    request, reply = (kind.replace("cid string", "cid int") for kind in (REQUEST, REPLY))
    q = session.createDataFrame([(0, 1, T0), (1, 1, T0)], request)
    p = session.createDataFrame([(0, 1, True, T0 + timedelta(seconds=1))], reply)
    for pack_rows in (None, 1):
        out = pending.replay_outcomes(
            q, p, f"{folder}/{pack_rows}", timeout=TIMEOUT, pack_rows=pack_rows
        )
        assert {r.cid: r.ok for r in out.collect()} == {0: True, 1: False}


def test_packs_and_slots_grow_with_the_rows(session):
    times = session.range(1000).select((F.lit(T0) + F.make_dt_interval(secs="id")).alias("ts"))
    assert pending.pack_sizes(times, 1000, 1000, 15) == {"packs": 1, "slot_timeouts": 66}
    assert pending.pack_sizes(times, 16_000, 1000, 15) == {"packs": 4, "slot_timeouts": 17}
    assert pending.pack_sizes(times, 10**9, 1000, 15) == {
        "packs": 1000,
        "slot_timeouts": pending.SLOT,
    }
    assert pending.pack_sizes(times.limit(0), 0, 1000, 15)["packs"] == 1


def test_a_pack_by_the_wall_clock(session, folder):
    """Ids of one key: one answered, the others out in time with nothing after them."""
    now = datetime.now()
    rows = session.createDataFrame([(c, 1, now) for c in ("a", "b", None)], REQUEST)
    rows.write.parquet(f"{folder}/q")
    session.createDataFrame([], REPLY).write.parquet(f"{folder}/p")
    live = pending.reply_outcomes_live(
        topics.file_topic(session, f"{folder}/q", rows.schema),
        topics.file_topic(session, f"{folder}/p", REPLY),
        timeout_seconds=20,
        clock="wall",
        packs=1,
    )
    writer = live.writeStream.format("parquet").option("path", f"{folder}/out")
    query = writer.option("checkpointLocation", f"{folder}/c").outputMode("append").start()
    try:
        answer = [("b", 1, True, now + timedelta(seconds=2))]
        session.createDataFrame(answer, REPLY).write.mode("append").parquet(f"{folder}/p")
        end, found = time.time() + TIMEOUT, []
        while len(found) < 3 and time.time() < end:
            assert query.exception() is None
            time.sleep(0.5)
            if list(Path(folder.removeprefix("file:")).glob("out/*.parquet")):
                found = session.read.schema(live.schema).parquet(f"{folder}/out").collect()
        assert {r.cid: (r.ok, r.result) for r in found} == {
            "b": (True, True),
            "a": (False, None),
            None: (False, None),
        }
    finally:
        query.stop()


@pytest.mark.parametrize(
    "name,label",
    [("reply_outcomes_live", "live-outcomes"), ("reply_timeouts_live", "live-timeouts")],
)
def test_the_query_packs_its_ids(spark, sf_dir, name, label):
    root = Path(scratch_root(spark).removeprefix("file:")) / "tidewheel"
    before = set(root.glob(f"{label}-*"))
    rows = QUERIES[name](spark, sf_dir).count()
    (folder,) = set(root.glob(f"{label}-*")) - before
    assert 0 < len(keys(streaming_session(spark), f"{folder}/checkpoint")) < rows / 20
