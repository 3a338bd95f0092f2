"""Headers, payloads and message scoring on small literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import headers as hd
from tidewheel.functions import payloads as pl
from tidewheel.functions import scoring as sc
from tidewheel.functions.clock import epoch_micros
from tidewheel.schemas import MESSAGE_SCHEMA
from tidewheel.streaming import scoring as st

HEADERS = "id int, headers array<struct<key string, value binary>>"
MODEL = sc.Model(
    np.array([0, 1]),
    np.array([5.0, 5.0]),
    np.array([0.5, 0.5]),
    np.array([[0.0, 0.0], [2.0, 2.0]]),
    np.ones((2, 2)),
)


def test_headers(spark):
    rows = [
        (0, [("correlationId", b"a"), ("instanceId", b"1"), ("x", b"\x00")]),
        (1, [("instanceId", b"1"), ("correlationId", b"a"), ("correlationId", b"b")]),
        (2, [("correlationId", b"a"), ("correlationId", None)]),
        (3, []),
        (4, None),
        (5, [("correlationid", b"a"), ("instanceId", b"")]),
        (6, [("correlationId", "grün".encode())]),
    ]
    df = spark.createDataFrame(rows, HEADERS)
    out = [
        [(h["key"], bytes(h["value"])) for h in r["h"]]
        for r in df.orderBy("id").select(hd.header_forward("headers").alias("h")).collect()
    ]
    assert out == [
        [("correlationId", b"a"), ("instanceId", b"1")],
        [("correlationId", b"b"), ("instanceId", b"1")],
        [],
        [],
        [],
        [("instanceId", b"")],
        [("correlationId", "grün".encode())],
    ]
    decoded = df.where("id = 6").select(hd.header_decode("headers").alias("h")).first()
    assert decoded["h"][0]["value"] == "grün"
    missing = df.where("id = 2").select(hd.header_decode("headers").alias("h")).first()
    assert missing["h"][1]["value"] is None


TEXTS = {
    "true": "true",
    " false ": "false",
    "null": "null",
    '{"k": 12}': '{"k":12}',
    "[1, 2]": "[1,2]",
    '"s"': '"s"',
    "12": "12",
    "oops": "oops",
    "": "",
    " ": " ",
    "12 apples": "12 apples",
    "true oops": "true oops",
    "1 2": "1 2",
    "1,2": "1,2",
    "[1] ]": "[1] ]",
    "1] x": "1] x",
    '{"a":1} x': '{"a":1} x',
    "{'a':1}": "{'a':1}",
    "[1,]": "[1,]",
    "01": "01",
    "+1": "+1",
    "NaN": "NaN",
}


def test_json_or_raw(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "v string")
    rows = df.select(
        "v", pl.json_or_raw("v").alias("p"), pl.json_boolean("v").alias("b")
    ).collect()
    assert {r["v"]: r["p"] for r in rows} == {**TEXTS, None: ""}
    assert {r["v"]: r["b"] for r in rows if r["b"] is not None} == {
        "true": True,
        " false ": False,
    }

    def strict(text):
        def refuse(name):
            raise ValueError(name)

        try:
            return json.dumps(json.loads(text, parse_constant=refuse), separators=(",", ":"))
        except ValueError:
            return text

    assert {t: strict(t) for t in TEXTS} == TEXTS


def test_parse_int_prefix(spark):
    cases = {
        "12abc": 12,
        "x": 0,
        "": 0,
        "  42\n": 42,
        "-7.9": -7,
        "+5": 5,
        "--5": 0,
        "0x1F": 31,
        "-0x10z": -16,
        "0x": 0,
        "1e3": 1,
        "﻿ 8": 8,
        "١": 0,
        "99999999999999999999": 2**63 - 1,
        "-99999999999999999999": -(2**63),
        "0xFFFFFFFFFFFFFFFFFF": 2**63 - 1,
        "0x000000000000000000FF": 255,
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "s string")
    rows = df.select("s", pl.parse_int_prefix("s").alias("n")).collect()
    assert {r["s"]: r["n"] for r in rows} == {**cases, None: 0}


def test_reply_envelope(spark):
    df = spark.createDataFrame([(True, "true"), (True, "oops"), (False, None)], "ok boolean, v string")
    texts = df.select(pl.reply_envelope("ok", "v").alias("r")).collect()
    assert [json.loads(r["r"]) for r in texts] == [
        {"ok": True, "result": "true"},
        {"ok": True, "result": "oops"},
        {"ok": False, "error": "Failed to send or receive from Kafka"},
    ]
    parsed = df.limit(1).select(pl.reply_envelope("ok", pl.parsed_json("v")).alias("r"))
    assert parsed.first()["r"] == '{"ok":true,"result":true}'


@pytest.mark.parametrize("form", ["expression", "batch"])
def test_score_messages(spark, form):
    cid = [("correlationId", b"c")]
    cases = [
        ('{"f0": 1.9, "f1": 2.2}', True, None),
        ('{"z": "1.9", "a": "2.2"}', True, None),
        ('{"f0": 0, "f1": 1e-3}', False, None),
        ('{"f0": "x", "f1": 1}', None, "bad_feature"),
        ('{"f0": null, "f1": 1}', None, "bad_feature"),
        ('{"f0": 1}', None, "feature_count"),
        ('{"f0": 1, "f1": 2, "f2": 3}', None, "feature_count"),
        ("{}", None, "feature_count"),
        ('{"f0": 1, "f0": 2}', None, "repeated_key"),
        ('{"f0": 1, "f1": 2} x', None, "bad_value"),
        ('{"f0": {"f1": 2}, "f2": 1}', None, "bad_value"),
        ('{"f0": [1], "f1": 2}', None, "bad_feature"),
        (' {"f0": 0, "f1": 0}\n', False, None),
        ("not json", None, "bad_value"),
        (None, None, "bad_value"),
        ('{"f0": "NaN", "f1": 1}', False, None),
        ('{"f0": "inf", "f1": 1}', False, None),
        ('{"f0": "1d", "f1": 1}', None, "bad_feature"),
        ('{"f0": "2f", "f1": "1_000"}', None, "bad_feature"),
        ('{"f0": true, "f1": false}', False, None),
        ('{"f0": "true", "f1": 1}', None, "bad_feature"),
        ('{"f{0}": 1.9, "f\\"}1": "2.2"}', True, None),
        ('{"f0": "{", "f1": 1}', None, "bad_feature"),
        ("{" + '"' * 30001, None, "bad_value"),
        ('{"' + "\\\\" * 20000 + '": 1}', None, "feature_count"),
    ]
    rows = [(v.encode() if v is not None else None, cid, None) for v, _, _ in cases]
    scored = st.score_messages(spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1), MODEL, form)
    found = scored.collect()
    assert [(r["result"], r["error"]) for r in found] == [c[1:] for c in cases]
    assert all(r["out_headers"][0]["key"] == "correlationId" for r in found)
    good = [bytes(r["value"]) for r in st.result_messages(scored).collect()]
    assert good == [b"true", b"true", *[b"false"] * 5, b"true"]
    assert st.rejected_messages(scored).count() + len(good) == len(cases)


def test_headers_of_any_bytes_are_read(spark):
    rows = [(b'{"f0": 0, "f1": 0}', [("correlationId", b"\xff\xfe"), ("x", None)], None)]
    scored = st.score_messages(spark.createDataFrame(rows, MESSAGE_SCHEMA), MODEL)
    assert "correlationId=" in st.event_log(scored).first()["line"]
    assert bytes(scored.first()["out_headers"][0]["value"]) == b"\xff\xfe"


def test_order_of_values_decides(spark):
    rows = [(b'{"f1": 2.5, "f0": -9.0}',), (b'{"f0": -9.0, "f1": 2.5}',)]
    df = spark.createDataFrame(rows, "value binary").coalesce(1)
    x = [r["x"] for r in df.select(pl.json_features("value").alias("x")).collect()]
    assert x == [[2.5, -9.0], [-9.0, 2.5]]


def test_correlation_ids_repeat_for_the_same_row(spark):
    df = spark.range(1000).select("id", F.lit(1_700_000_000_123).alias("ms"))
    ids = df.select("id", pl.correlation_id("ms", "id").alias("c"))
    first = dict(ids.collect())
    assert len(set(first.values())) == 1000
    assert first == dict(ids.repartition(7).collect())
    assert first[5].startswith("consumer-id-1700000000123-")


def test_epoch_micros_ignores_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.000007' as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.select(epoch_micros(df, "t")).first()[0] == 1710037800000007
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    zoned = spark.sql("select timestamp_micros(77) as t")
    assert zoned.select(epoch_micros(zoned, "t")).first()[0] == 77


