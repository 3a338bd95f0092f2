"""Reply matching, counters and backlog against brute force, with hot keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import correlation as co
from tidewheel.operators import counters as ct
from tidewheel.operators import metrics as mt
from tidewheel.session import scratch_path

T0 = datetime(2024, 1, 1)
REQUESTS = "cid string, inst bigint, ts timestamp_ntz"
REPLIES = "cid string, inst bigint, result boolean, reply_ts timestamp_ntz"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def outcomes(requests, replies, timeout=15, match_instance=True):
    """First reply in time per request, by looking at all pairs."""
    found = {}
    for cid, inst, ts in requests:
        fitting = [
            (reply_ts, result)
            for c, i, result, reply_ts in replies
            if c and c == cid
            and (not match_instance or (i is not None and i == inst))
            and ts <= reply_ts < ts + timedelta(seconds=timeout)
        ]
        found[cid, inst, ts] = min(fitting, default=(None, None))
    return found


def as_dict(df):
    return {
        (r["cid"], r["inst"], r["ts"]): (r["reply_ts"], r["result"]) for r in df.collect()
    }


def test_literal_cases(spark):
    requests = [(c, 1, at(100)) for c in "abcdefgh"]
    replies = [
        ("a", 1, True, at(115)),  # exactly at the time-out
        ("b", 1, True, at(114.999999)),
        ("c", 1, True, at(103)),  # first of two
        ("c", 1, False, at(105)),
        ("d", 1, True, at(99.999999)),  # before the request
        ("e", 2, True, at(101)),  # other instance
        ("f", 1, False, at(100)),  # at once
        ("zz", 1, True, at(101)),  # nobody asked
        ("", 1, True, at(101)),
        (None, 1, True, at(101)),
        ("g", None, True, at(101)),
    ]
    q = spark.createDataFrame(requests, REQUESTS)
    p = spark.createDataFrame(replies, REPLIES)
    ok = {
        r["cid"]: (r["ok"], r["result"]) for r in co.reply_roundtrip(q, p).collect()
    }
    late = (False, None)
    assert ok == {
        "a": late,
        "b": (True, True),
        "c": (True, True),
        "d": late,
        "e": late,
        "f": (True, False),
        "g": late,
        "h": late,
    }
    anyone = co.reply_roundtrip(q, p, match_instance=False).where("ok")
    assert {r["cid"] for r in anyone.collect()} == {"b", "c", "e", "f", "g"}
    assert {r["cid"] for r in co.reply_timeouts(q, p).collect()} == set("adegh")
    matched = co.reply_match(q, p).collect()
    assert sorted(r["cid"] for r in matched) == ["b", "c", "c", "f"]
    assert co.reply_roundtrip(q, p, timeout_seconds=1).where("ok").count() == 1


def skewed(seed, rows=3000):
    """A third of the replies, and many requests over time, share one id."""
    rng = random.Random(seed)
    requests, replies = [], []
    for i in range(rows):
        hot = rng.random() < 0.34
        cid = "hot" if hot else f"c{i}"
        sent = rng.uniform(0, 600) if hot else rng.uniform(0, 86_400)
        if not hot or rng.random() < 0.2:
            requests.append((cid, 1, at(round(sent, 3))))
        for _ in range(rng.choice([0, 1, 1, 2])):
            wait = rng.choice([-1, 0, 3, 14.999, 15, 20])
            replies.append(
                (cid, rng.choice([1, 1, 1, 2]), rng.random() < 0.5, at(round(sent + wait, 3)))
            )
    # Repeats at one instant, with both results.
    replies += [("hot", 1, flag, at(300)) for flag in (True, False) for _ in range(500)]
    return list(dict.fromkeys(requests)), replies


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("match_instance", [True, False])
def test_hot_ids_give_the_same_outcomes(spark, seed, match_instance):
    requests, replies = skewed(seed)
    q = spark.createDataFrame(requests, REQUESTS)
    p = spark.createDataFrame(replies, REPLIES)
    options = {"match_instance": match_instance}
    wanted = outcomes(requests, replies, **options)
    found = co.reply_roundtrip(q, p, **options)
    assert found.count() == len(requests)
    assert as_dict(found) == wanted


def test_hot_ids_give_the_same_matches(spark):
    requests, replies = skewed(3)
    hot_request = [("hot", 1, at(290))]
    requests = [r for r in requests if r[0] != "hot"] + hot_request
    q = spark.createDataFrame(requests, REQUESTS)
    p = spark.createDataFrame(replies, REPLIES)
    wanted = sorted(
        (c, r, t)
        for cid, inst, ts in requests
        for c, i, r, t in replies
        if c == cid and i == inst and ts <= t < ts + timedelta(seconds=15)
    )
    rows = co.reply_match(q, p).collect()
    assert sorted((r["cid"], r["result"], r["reply_ts"]) for r in rows) == wanted


@pytest.mark.parametrize("order", [1, -1])
def test_a_missing_result_wins_over_others_at_one_instant(spark, order):
    q = spark.createDataFrame([("a", 1, at(0))], REQUESTS)
    rows = [("a", 1, None, at(1)), ("a", 1, True, at(1)), ("a", 1, False, at(1))]
    p = spark.createDataFrame(rows[::order] * 300, REPLIES)
    (row,) = co.reply_roundtrip(q, p).collect()
    assert (row["ok"], row["result"], row["reply_ts"]) == (True, None, at(1))


def test_requests_without_a_time_stay_unanswered(spark):
    q = spark.createDataFrame([("a", 1, None), ("b", 1, at(5))], REQUESTS)
    p = spark.createDataFrame([("a", 1, True, at(1)), ("b", 1, True, None)], REPLIES)
    assert {r["cid"]: r["ok"] for r in co.reply_roundtrip(q, p).collect()} == {
        "a": False,
        "b": False,
    }
    assert co.reply_match(q, p).count() == 0


def test_a_hot_id_spreads_over_slots(spark):
    _, replies = skewed(4)
    p = spark.createDataFrame(replies, REPLIES).where("cid = 'hot' and inst = 1")
    q = spark.createDataFrame([("hot", 1, at(0))], REQUESTS)
    rows, _ = co._prepare(q, p, 15, True)
    sizes = [r["count"] for r in rows.groupBy("slot").count().collect()]
    assert len(sizes) > 30
    assert max(sizes) < p.count() / 4
    # The 1000 repeats at one instant became one row per slot they matter in.
    repeats = rows.where((F.col("at") == F.lit(at(300)).cast("timestamp_ntz")))
    assert repeats.count() == 2
    lost = spark.range(5000).selectExpr("cast(null as string) cid", "1L inst", "cast(null as timestamp_ntz) ts", "id n")
    nowhere, _ = co._prepare(lost, p, 15, True)
    assert nowhere.where("request is not null").select("slot").distinct().count() > 4000


def test_requests_without_id_time_out(spark):
    q = spark.createDataFrame([(None, 1, at(0)), ("", 1, at(0))], REQUESTS)
    p = spark.createDataFrame([(None, 1, True, at(1)), ("", 1, True, at(1))], REPLIES)
    assert [r["ok"] for r in co.reply_roundtrip(q, p).collect()] == [False, False]


def test_route_filters(spark):
    p = spark.createDataFrame(
        [("a", 1, True, at(0)), ("b", 2, True, at(0)), ("", 1, True, at(0)), (None, 1, True, at(0))],
        REPLIES,
    )
    assert [r["cid"] for r in co.route_filter(p, 1).collect()] == ["a"]
    assert [r["inst"] for r in co.single_reply_filter(p, "b").collect()] == [2]


def test_backlog_with_repeated_results(spark):
    q = spark.createDataFrame([(c, 1, at(i * 86_400)) for i, c in enumerate("abc")], REQUESTS)
    p = spark.createDataFrame([("b", 1, True, at(0))] * 50, REPLIES)
    rows = co.topic_backlog(q, p, F.to_date("ts")).orderBy("bucket").collect()
    assert [(str(r["bucket"]), r["backlog"]) for r in rows] == [
        ("2024-01-01", 1),
        ("2024-01-03", 1),
    ]


@pytest.mark.parametrize("slices", [None, 1, 3, 16])
def test_visit_numbers(spark, slices):
    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "a", "a", "b", f"p{i % 40}"]), at(rng.choice([0, 1, 2, i])), i)
        for i in range(4000)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page string, ts timestamp_ntz, n int")
    seen, wanted = {}, {}
    for page, _, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        wanted[n] = seen[page] = seen.get(page, 0) + 1
    folder = scratch_path(spark, "numbers")
    found = ct.visit_number(df, folder, order=("ts", "n"), slices=slices)
    assert found.columns == [*df.columns, "visit"]
    assert {r["n"]: r["visit"] for r in found.collect()} == wanted
    # A page of a quarter of a per cent and one of a third are cut alike.
    if slices == 16:
        sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_slice").count().collect()]
        assert max(sizes) < 3 * 4000 / 16
    counted = {r["page"]: r["visits"] for r in ct.visit_count(df).collect()}
    assert counted == seen


@pytest.mark.parametrize("order", [1, -1])
def test_of_two_samples_at_one_instant_the_greater_counts(spark, order):
    rows = [("a", {"x": "1"}, at(1), 1.0), ("a", {"x": "1"}, at(1), 2.0)][::order]
    schema = "name string, labels map<string,string>, ts timestamp_ntz, value double"
    assert mt.metric_latest(spark.createDataFrame(rows, schema)).first()["value"] == 2.0


def test_backlog_counts_requests_without_an_id(spark):
    q = spark.createDataFrame([(None, 1, at(0)), (None, 1, at(0)), ("a", 1, at(0))], REQUESTS)
    p = spark.createDataFrame([("a", 1, True, at(1)), (None, 1, True, at(1))], REPLIES)
    assert [r["backlog"] for r in co.topic_backlog(q, p, F.to_date("ts")).collect()] == [2]


def test_metrics(spark):
    rows = [
        ("replicas", {"deployment": "a", "ns": "x"}, at(1), 1.0),
        ("replicas", {"ns": "x", "deployment": "a"}, at(2), 3.0),
        ("replicas", {"deployment": "b", "ns": "x"}, at(5), 4.0),
        ("replicas", {"deployment": "b", "ns": "x"}, at(4), 8.0),
        ("cpu", {"deployment": "a"}, at(9), 9.0),
    ]
    df = spark.createDataFrame(
        rows, "name string, labels map<string,string>, ts timestamp_ntz, value double"
    )
    assert mt.metric_latest(df).count() == 3
    one = mt.metric_latest(df, "replicas", {"deployment": "a"}).collect()
    assert [(r["labels"], r["value"]) for r in one] == [({"deployment": "a", "ns": "x"}, 3.0)]
    b = mt.metric_latest(df, labels={"deployment": "b"}).first()
    assert b["value"] == 4.0
