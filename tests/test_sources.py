"""Synthetic load, files and options."""

import json

import pytest
from pyspark.sql import functions as F

from tidewheel.plans import tables as tb
from tidewheel.schemas import FORM_FIELDS, LOAD_FIELDS, MODEL_SCHEMA
from tidewheel.session import scratch_path, streaming_session
from tidewheel.sources import lake, load, model_store
from tidewheel.streaming.runner import run_available


def test_load_is_uniform_and_repeats(spark):
    rows = load.synthetic_load(spark.range(20_000), "id")
    values = rows.select(F.from_json("value", "map<string,double>").alias("m"))
    columns = values.select(*[F.col("m")[f].alias(f) for f in LOAD_FIELDS])
    stats = columns.agg(
        *[F.avg(f).alias(f"a{f}") for f in LOAD_FIELDS],
        *[F.min(f).alias(f"l{f}") for f in LOAD_FIELDS],
        *[F.max(f).alias(f"h{f}") for f in LOAD_FIELDS],
        *[F.corr("f0", f).alias(f"c{f}") for f in LOAD_FIELDS[1:]],
    ).first().asDict()
    for f in LOAD_FIELDS:
        assert abs(stats[f"a{f}"] - 0.5) < 0.01
        assert 0 <= stats[f"l{f}"] < 0.01 and 0.99 < stats[f"h{f}"] < 1
    assert max(abs(v) for k, v in stats.items() if k.startswith("c")) < 0.05
    again = load.synthetic_load(spark.range(20_000).repartition(5), "id")
    assert rows.exceptAll(again).count() == 0
    other = load.synthetic_load(spark.range(100), "id", seed=1)
    assert other.join(rows, ["id", "value"]).count() == 0
    assert list(json.loads(rows.first()["value"])) == LOAD_FIELDS


def test_form_values_are_two_digit_texts(spark):
    form = json.loads(load.form_random_fill(spark.range(1), "id").first()["value"])
    assert list(form) == FORM_FIELDS and len(FORM_FIELDS) == 30
    assert all(isinstance(v, str) and len(v) == 4 for v in form.values())


def test_load_stream_ticks(spark):
    session = streaming_session(spark)
    folder = scratch_path(spark, "t")
    stream = load.synthetic_load_stream(session, 200)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/c")
        .trigger(processingTime="1 second")
        .start()
    )
    query.awaitTermination(6)
    query.stop()
    rows = spark.read.parquet(f"{folder}/out")
    assert rows.count() > 0
    assert list(json.loads(rows.first()["value"])) == LOAD_FIELDS


def test_stored_tables_stream_whether_file_or_folder(spark, sf_dir):
    session = streaming_session(spark)
    folder = scratch_path(spark, "t")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(
        f"{folder}/sf/events.parquet"
    )
    for i, where in enumerate((sf_dir, f"{folder}/sf")):
        stream = tb.table_stream(session, where, "events", 2**30)
        run_available(stream, f"{folder}/c{i}", f"{folder}/out{i}", timeout=120)
        assert spark.read.parquet(f"{folder}/out{i}").count() == 1000


def test_model_with_special_values_survives_storage(spark, tmp_path):
    record = spark.createDataFrame(
        [([1.0], [1.0], [0], [[float("nan"), float("inf")]], [[0.1, 1 / 3]])], MODEL_SCHEMA
    )
    path = str(tmp_path / "m")
    model_store.model_json_write(record, path)
    model_store.model_json_write(record, path)
    assert str(model_store.model_json_read(spark, path).collect()) == str(record.collect())


def test_ingest_adds_objects_and_keeps_bytes(spark, tmp_path):
    raw, landing = tmp_path / "raw.data", tmp_path / "landing"
    raw.write_bytes(b"1,M,0.5\r\n2,B,x y\r\n\n3")
    (tmp_path / "b.txt").write_bytes(b"later\n")
    lake.lake_ingest(spark, str(raw), str(landing))
    again = lake.lake_ingest(spark, str(tmp_path / "b.txt"), str(landing))
    assert [r["value"] for r in again.collect()] == ["later"]
    landed = {
        p.parent.name: p.read_bytes() for p in landing.glob("*/part-*") if p.stat().st_size
    }
    assert landed == {"raw.data": b"1,M,0.5\r\n2,B,x y\r\n\n3\n", "b.txt": b"later\n"}
    assert lake.lake_show(spark, f"{landing}/*").count() == 5
    assert lake.lake_show(spark, str(raw)).count() == 4
    assert lake.lake_listing(spark, str(tmp_path), "raw*").count() == 1


def test_ingest_replaces_its_own_name(spark, tmp_path):
    landing = f"{tmp_path}/landing/"
    for name, text in (("a", "1\n2\n"), ("b", "3\n"), ("a", "1\n2\n"), ("a", "4\n")):
        (tmp_path / name).write_text(text)
        lake.lake_ingest(spark, f"{tmp_path}/{name}", landing)
    lake.lake_ingest(spark, f"{tmp_path}/a", landing, name="c")
    lines = lake.lake_show(spark, f"{landing}*").collect()
    assert sorted(r["value"] for r in lines) == ["3", "4", "4"]
    assert sorted(p.name for p in (tmp_path / "landing").iterdir()) == ["a", "b", "c"]
    # A copy that fails leaves the object as it is.
    with pytest.raises(Exception):
        lake.lake_ingest(spark, f"{tmp_path}/absent", landing, name="b")
    assert lake.lake_show(spark, f"{landing}b").count() == 1


def test_store_options_reach_the_reader(spark, tmp_path):
    """Options are a reader's own, so what they say holds for it: a line separator here."""
    (tmp_path / "x").write_text("a;b;c")
    assert lake.lake_show(spark, f"{tmp_path}/x", {"lineSep": ";"}).count() == 3
    rows = lake.csv_named_scan(
        spark, f"{tmp_path}/x", "a string, b string, c string", {"sep": ";"}
    )
    assert [tuple(r) for r in rows.collect()] == [("a", "b", "c")]


def test_store_options_carry_no_keys():
    options = lake.object_store_options("http://store:9000")
    assert options["fs.s3a.path.style.access"] == "true"
    assert options["fs.s3a.connection.ssl.enabled"] == "false"
    assert not [k for k in options if "key" in k or "secret" in k]
