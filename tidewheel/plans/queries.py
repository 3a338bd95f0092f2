"""One named query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import headers as hd
from tidewheel.functions import payloads as pl
from tidewheel.functions import scoring as sc
from tidewheel.functions.clock import epoch_micros
from tidewheel.operators import correlation as co
from tidewheel.operators import counters as ct
from tidewheel.operators import long_scoring as lg
from tidewheel.operators import metrics as mt
from tidewheel.operators import training as tr
from tidewheel.plans import tables as tb
from tidewheel.schemas import (
    CORRELATION_HEADER,
    FEATURE_COLUMNS,
    INSTANCE_HEADER,
    MESSAGE_SCHEMA,
    REQUEST_TOPIC,
    RESULT_TOPIC,
    training_schema,
)
from tidewheel.session import scratch_path, streaming_session
from tidewheel.sources import lake, load, model_store, topics
from tidewheel.streaming import counts
from tidewheel.streaming import scoring as st
from tidewheel.streaming.correlation import replay_roundtrip
from tidewheel.streaming.pending import PACK_ROWS, replay_outcomes
from tidewheel.streaming.progress import ProgressLog, live_backlog, observed
from tidewheel.streaming.runner import finished, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# Most a micro-batch reads from a stored table.
TRIGGER_BYTES = 256 * 2**30


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _events(spark, sf_dir):
    return tb.table(spark, sf_dir, "events")


def _rounded(rows: DataFrame) -> DataFrame:
    """Variances of prices are large, so fewer of their digits agree."""
    return rows.withColumn("theta", F.round("theta", 6)).withColumn(
        "sigma",
        F.when(F.col("sigma") > 10_000, F.round("sigma", 2)).otherwise(
            F.round("sigma", 6)
        ),
    )


# Sources and sinks


def _line_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "lines-csv")
    tb.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", *tb.LINE_FEATURES
    ).write.csv(path, header=False)
    return path


@query
def csv_named_scan(spark, sf_dir):
    schema = training_schema(["feature_1", "feature_2", "feature_3", "feature_4"])
    return lake.csv_named_scan(spark, _line_csv(spark, sf_dir), schema)


def _stored_model(spark, sf_dir) -> str:
    path = scratch_path(spark, "model")
    model_store.model_json_write(tb.line_model_record(spark, sf_dir), path)
    return path


@query
def model_json_write(spark, sf_dir):
    document = F.try_parse_json("value")

    def numbers(key):
        return F.try_variant_get(document, f"$.{key}", "array<double>").alias(key)

    text = lake.lake_show(spark, _stored_model(spark, sf_dir))
    return (
        text.select(*map(numbers, ("classes_", "class_count_", "class_prior_")))
        .select(F.explode(F.arrays_zip("classes_", "class_count_", "class_prior_")))
        .select(
            F.col("col.classes_").cast("int").alias("class_"),
            F.col("col.class_count_").alias("class_count"),
            F.round("col.class_prior_", 9).alias("class_prior"),
        )
    )


@query
def model_json_read(spark, sf_dir):
    record = model_store.model_json_read(spark, _stored_model(spark, sf_dir))
    rows = _rounded(tr.model_rows(record))
    return rows.withColumn("class_prior", F.round("class_prior", 9))


def _landed(spark, sf_dir, topic: str) -> str:
    """Brokers of a folder topic that holds every line as a message."""
    brokers = f"{topics.FOLDER}{scratch_path(spark, topic)}"
    topics.land_messages(tb.line_messages(tb.table(spark, sf_dir, "lineitem")), brokers, topic)
    return brokers


def _received(spark, brokers: str) -> DataFrame:
    return topics.topic_source(
        streaming_session(spark), brokers, REQUEST_TOPIC, max_bytes_per_trigger=TRIGGER_BYTES
    )


@query
def topic_source(spark, sf_dir):
    brokers = _landed(spark, sf_dir, REQUEST_TOPIC)
    folder = scratch_path(spark, "topic-source")
    run_available(_received(spark, brokers), f"{folder}/checkpoint", f"{folder}/out")
    received = spark.read.schema(MESSAGE_SCHEMA).parquet(f"{folder}/out")
    return received.select(
        hd.header_lookup("headers", CORRELATION_HEADER).cast("string").alias("cid"),
        F.col("value").cast("string").alias("value"),
    )


def _read_model(spark, sf_dir) -> sc.Model:
    return sc.load_model(model_store.model_json_read(spark, _stored_model(spark, sf_dir)))


def _scored_stream(spark, sf_dir) -> DataFrame:
    lines = tb.table_stream(streaming_session(spark), sf_dir, "lineitem", TRIGGER_BYTES)
    return st.score_messages(tb.line_messages(lines), _read_model(spark, sf_dir))


@query
def topic_sink(spark, sf_dir):
    brokers = _landed(spark, sf_dir, REQUEST_TOPIC)
    scored = st.score_messages(_received(spark, brokers), _read_model(spark, sf_dir))
    checkpoint = f"{scratch_path(spark, 'topic-sink')}/checkpoint"
    finished(topics.topic_sink(st.result_messages(scored), brokers, RESULT_TOPIC, checkpoint))
    return (
        topics.topic_table(spark, brokers, RESULT_TOPIC)
        .select(
            F.col("value").cast("string").alias("value"),
            F.posexplode(hd.header_decode("headers")).alias("place", "h"),
        )
        .select("value", "place", "h.key", F.col("h.value").alias("text"))
    )


@query
def request_producer(spark, sf_dir):
    messages = topics.request_producer(
        _events(spark, sf_dir),
        ["event_type", "user_id", "value"],
        F.col("event_id").cast("string"),
        (F.col("user_id") % 3).cast("string"),
        "event_id",
    )

    def text(key):
        return hd.header_lookup("headers", key).cast("string")

    return messages.select(
        "event_id",
        F.col("value").cast("string").alias("value"),
        text(CORRELATION_HEADER).alias("cid"),
        text(INSTANCE_HEADER).alias("inst"),
    )


@query
def results_from_latest(spark, sf_dir):
    stored = tb.replies(_events(spark, sf_dir))
    seen = topics.results_from_latest(stored, "2024-01-16 00:00:00", "reply_ts")
    return seen.withColumn("reply_ts", F.date_format("reply_ts", STAMP))


@query
def results_from_latest_stream(spark, sf_dir):
    """A consumer joins after the early replies landed, stops, and goes on later."""
    session = streaming_session(spark)
    folder = scratch_path(spark, "joined")
    stored = tb.replies(_events(spark, sf_dir))
    late, later = (
        F.col("reply_ts") > F.lit(at).cast("timestamp_ntz")
        for at in ("2024-01-16 00:00:00", "2024-01-24 00:00:00")
    )
    for arrived in (stored.where(~late), stored.where(late & ~later), stored.where(later)):
        arrived.write.mode("append").parquet(f"{folder}/topic")
        stream = topics.file_topic(session, f"{folder}/topic", stored.schema)
        topics.start_from_latest(stream, f"{folder}/checkpoint", f"{folder}/out")
        run_available(stream, f"{folder}/checkpoint", f"{folder}/out")
    seen = spark.read.schema(stored.schema).parquet(f"{folder}/out")
    return seen.withColumn("reply_ts", F.date_format("reply_ts", STAMP))


def _message_values(messages: DataFrame, kind: str, decimals: int) -> DataFrame:
    """The messages' fields, and their first, last and summed values; each message is
    parsed once."""
    values = F.map_values("m")
    if kind != "double":
        values = F.transform(values, lambda v: v.try_cast("double"))
    return (
        messages.select("event_id", F.from_json("value", f"map<string,{kind}>").alias("m"))
        .select("event_id", F.map_keys("m").alias("names"), values.alias("x"))
        .select(
            "event_id",
            F.array_join("names", ",").alias("fields"),
            F.round(F.get("x", F.lit(0)), decimals).alias("first"),
            F.round(F.element_at("x", -1), decimals).alias("last"),
            F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
        )
    )


@query
def synthetic_load(spark, sf_dir):
    messages = load.synthetic_load(_events(spark, sf_dir), "event_id")
    return _message_values(messages, "double", 12)


@query
def form_random_fill(spark, sf_dir):
    messages = load.form_random_fill(_events(spark, sf_dir), "event_id")
    return _message_values(messages, "string", 2)


@query
def lake_listing(spark, sf_dir):
    folder = scratch_path(spark, "listed")
    events = _events(spark, sf_dir)
    events.select(F.col("event_id").cast("string"), "event_type").write.partitionBy(
        "event_type"
    ).text(folder)
    kind = F.regexp_extract("path", "/event_type=([^/]+)/", 1).alias("kind")
    found = lake.lake_listing(spark, folder, "part-*")
    return found.groupBy(kind).agg(F.sum("length").alias("n_bytes"))


@query
def lake_ingest(spark, sf_dir):
    """Two files, the second of them twice under one name."""
    folder = scratch_path(spark, "ingest")
    events = _events(spark, sf_dir).select("event_id", "event_type", "user_id")
    late = F.col("event_id") % 2 == 1
    for name, rows in (("early", events.where(~late)), ("late", events.where(late))):
        rows.write.csv(f"{folder}/{name}")
    for name in ("early", "late", "late"):
        lake.lake_ingest(spark, f"{folder}/{name}", f"{folder}/landing")
    fields = F.split("value", ",")
    return (
        lake.lake_show(spark, f"{folder}/landing/*")
        .select(
            F.get(fields, F.lit(1)).alias("event_type"),
            F.get(fields, F.lit(0)).cast("bigint").alias("event_id"),
            F.get(fields, F.lit(2)).cast("bigint").alias("user_id"),
        )
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("event_id").alias("ids"),
            F.sum("user_id").alias("users"),
        )
    )


@query
def event_log(spark, sf_dir):
    messages = tb.line_messages(tb.table(spark, sf_dir, "lineitem"))
    scored = st.score_messages(messages, tb.line_model(spark, sf_dir))
    return st.event_log(scored, "l_orderkey", "l_linenumber")


@query
def event_counts(spark, sf_dir):
    """What the scoring stream reported of all its micro-batches, next to its rows."""
    session = streaming_session(spark)
    folder = scratch_path(spark, "observed")
    with ProgressLog(session, f"{folder}/progress") as log:
        lines = tb.table_stream(session, sf_dir, "lineitem", TRIGGER_BYTES)
        scored = st.score_messages(tb.line_messages(lines), _read_model(spark, sf_dir))
        log.wait(run_available(st.observe_events(scored), f"{folder}/checkpoint"))
    total = observed(session, f"{folder}/progress")
    counts = ("received", "scored", "rejected", "positive")
    return total.agg(*[F.sum(c).alias(c) for c in counts])


# Projection, filter, preprocessing


@query
def drop_column(spark, sf_dir):
    rows = tb.line_rows(spark, sf_dir).select("l_orderkey", "target", *tb.LINE_FEATURES)
    return tr.drop_column(rows, "l_orderkey")


@query
def label_recode(spark, sf_dir):
    rows = tb.line_rows(spark, sf_dir)
    return rows.groupBy("l_returnflag", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def label_counts(spark, sf_dir):
    return tr.label_counts(tb.line_rows(spark, sf_dir))


@query
def feature_assembly(spark, sf_dir):
    rows = tr.feature_assembly(tb.line_rows(spark, sf_dir), tb.LINE_FEATURES)
    return rows.select(
        "target",
        F.size("x").alias("width"),
        *[F.col("x")[i].alias(f"x{i}") for i in range(4)],
    )


@query
def table_shape(spark, sf_dir):
    return tr.table_shape(tb.table(spark, sf_dir, "lineitem"))


def _addressed(results: DataFrame) -> DataFrame:
    return results.withColumn("reply_ts", F.date_format("reply_ts", STAMP))


@query
def route_filter(spark, sf_dir):
    return _addressed(co.route_filter(tb.replies(_events(spark, sf_dir)), 1))


@query
def single_reply_filter(spark, sf_dir):
    return _addressed(co.single_reply_filter(tb.replies(_events(spark, sf_dir)), "26"))


# Training


@query
def nb_classes(spark, sf_dir):
    return tr.nb_classes(tb.embedding_rows(spark, sf_dir), "label")


@query
def nb_class_count(spark, sf_dir):
    return tr.nb_class_count(tb.line_rows(spark, sf_dir))


@query
def nb_class_prior(spark, sf_dir):
    priors = tr.nb_class_prior(tb.line_rows(spark, sf_dir))
    return priors.withColumn("class_prior", F.round("class_prior", 9))


def _moments(spark, sf_dir) -> DataFrame:
    return _rounded(tr.class_moments(tb.line_rows(spark, sf_dir), tb.LINE_FEATURES))


@query
def nb_theta(spark, sf_dir):
    return _moments(spark, sf_dir).select("class_", "pos", "theta")


@query
def nb_sigma(spark, sf_dir):
    return _moments(spark, sf_dir).select("class_", "pos", "sigma")


@query
def nb_model(spark, sf_dir):
    rows = _rounded(tr.model_rows(tb.line_model_record(spark, sf_dir)))
    return rows.withColumn("class_prior", F.round("class_prior", 9))


@query
def nb_model_array(spark, sf_dir):
    rows = _rounded(tr.model_rows(tb.embedding_model_record(spark, sf_dir)))
    return rows.withColumn("class_prior", F.round("class_prior", 9))


# Scoring


@query
def json_features(spark, sf_dir):
    messages = tb.line_messages(tb.table(spark, sf_dir, "lineitem"))
    x = pl.json_features("value")
    return messages.select("l_orderkey", "l_linenumber", x.alias("x")).select(
        "l_orderkey", "l_linenumber", *[F.col("x")[i].alias(f"x{i}") for i in range(4)]
    )


def _per_class(rows: DataFrame, scores: str, model: sc.Model, name: str) -> DataFrame:
    classes = F.array(*[F.lit(int(c)) for c in model.classes])
    return rows.select(
        "vec_id", F.explode(F.arrays_zip(classes.alias("c"), F.col(scores).alias("s")))
    ).select("vec_id", F.col("col.c").alias("class_"), F.round("col.s", 6).alias(name))


@query
def nb_log_likelihood(spark, sf_dir):
    model = tb.embedding_model(spark, sf_dir)
    rows = tb.embedding_rows(spark, sf_dir)
    scored = rows.select("vec_id", sc.nb_log_likelihood("embedding", model).alias("v"))
    return _per_class(scored, "v", model, "log_likelihood")


def _joints(spark, sf_dir):
    model = tb.embedding_model(spark, sf_dir)
    rows = tb.embedding_rows(spark, sf_dir)
    return rows.select("vec_id", sc.nb_log_joint("embedding", model).alias("j")), model


@query
def nb_log_joint(spark, sf_dir):
    joints, model = _joints(spark, sf_dir)
    return _per_class(joints, "j", model, "log_joint")


@query
def nb_proba(spark, sf_dir):
    joints, model = _joints(spark, sf_dir)
    scored = joints.select("vec_id", sc.nb_proba("j").alias("p"))
    return _per_class(scored, "p", model, "proba")


@query
def nb_argmax(spark, sf_dir):
    joints, model = _joints(spark, sf_dir)
    return joints.select("vec_id", sc.nb_argmax("j", model).alias("predicted"))


@query
def nb_is_positive(spark, sf_dir):
    model = tb.line_model(spark, sf_dir)
    scored = sc.nb_predict_batch(tb.line_rows(spark, sf_dir), tb.LINE_FEATURES, model)
    return scored.select("l_orderkey", "l_linenumber", "positive")


@query
def nb_predict_batch(spark, sf_dir):
    model = tb.line_model(spark, sf_dir)
    scored = sc.nb_predict_batch(tb.line_rows(spark, sf_dir), tb.LINE_FEATURES, model)
    return scored.groupBy("target", "predicted", "positive").agg(
        F.count(F.lit(1)).alias("n")
    )


def _wide_model(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All lines with 30 features, and the stored model trained on the labelled ones."""
    rows = tb.wide_line_rows(spark, sf_dir)
    path = scratch_path(spark, "model")
    record = tr.nb_model(rows.where(F.col("target").isNotNull()), FEATURE_COLUMNS)
    model_store.model_json_write(record, path)
    return rows, model_store.model_json_read(spark, path)


@query
def nb_model_wide(spark, sf_dir):
    rows = tr.model_rows(_wide_model(spark, sf_dir)[1])
    relative = F.format_string("%.6e", "sigma")
    return rows.select("class_", "pos", F.round("theta", 4).alias("theta"), relative.alias("sigma"))


@query
def nb_predict_wide(spark, sf_dir):
    rows, record = _wide_model(spark, sf_dir)
    scored = sc.nb_predict_batch(rows, FEATURE_COLUMNS, sc.load_model(record))
    return scored.select("l_orderkey", "l_linenumber", "positive")


@query
def nb_predict_array(spark, sf_dir):
    model = tb.embedding_model(spark, sf_dir)
    rows = tb.embedding_rows(spark, sf_dir)
    scored = sc.nb_predict_batch(rows, "embedding", model)
    return scored.groupBy("label", "predicted", "positive").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def nb_predict_stream(spark, sf_dir):
    folder = scratch_path(spark, "scored")
    scored = st.observe_events(_scored_stream(spark, sf_dir))
    run_available(scored, f"{folder}/checkpoint", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select(
        "l_orderkey", "l_linenumber", "result", "error"
    )


@query
def nb_predict_refreshed(spark, sf_dir):
    """Early lines are scored by the first model; before the others come, a model trained
    on the early lines alone is published, and scores them."""
    session = streaming_session(spark)
    folder = scratch_path(spark, "refreshed")
    lines = tb.line_rows(spark, sf_dir)
    early = F.col("l_linenumber") <= 3
    known = lines.where(F.col("target").isNotNull())
    for part, learnt in ((early, known), (~early, known.where(early))):
        model_store.publish_model(tr.nb_model(learnt, tb.LINE_FEATURES), f"{folder}/models")
        messages = tb.line_messages(lines.where(part))
        messages.write.mode("append").parquet(f"{folder}/messages")
        stream = topics.file_topic(session, f"{folder}/messages", messages.schema)
        finished(st.score_with_latest(stream, f"{folder}/models", folder))
    return st.scored_messages(session, folder).select("l_orderkey", "l_linenumber", "result")


def _long_embeddings(spark, sf_dir) -> tuple:
    model = lg.stored_model_rows(tb.embedding_model_record(spark, sf_dir))
    return tb.embedding_rows(spark, sf_dir), "vec_id", "embedding", model


@query
def nb_log_likelihood_long(spark, sf_dir):
    scores = lg.nb_log_likelihood_long(*_long_embeddings(spark, sf_dir), block=16)
    return scores.withColumn("log_likelihood", F.round("log_likelihood", 6))


@query
def nb_predict_long(spark, sf_dir):
    return lg.nb_predict_long(*_long_embeddings(spark, sf_dir), block=16)


# Headers, payloads, ids


def _header_messages(spark, sf_dir) -> DataFrame:
    return tb.header_messages(_events(spark, sf_dir))


@query
def header_decode(spark, sf_dir):
    pairs = F.posexplode(hd.header_decode("headers")).alias("place", "h")
    return (
        _header_messages(spark, sf_dir)
        .select("event_id", pairs)
        .select("event_id", "place", "h.key", F.col("h.value").alias("text"))
    )


@query
def header_lookup(spark, sf_dir):
    def text(key):
        return hd.header_lookup("headers", key).cast("string")

    return _header_messages(spark, sf_dir).select(
        "event_id",
        text(CORRELATION_HEADER).alias("cid"),
        text(INSTANCE_HEADER).alias("inst"),
    )


@query
def header_forward(spark, sf_dir):
    out = hd.header_decode(hd.header_forward("headers"))
    pairs = F.transform(out, lambda h: F.concat_ws("=", h["key"], h["value"]))
    return _header_messages(spark, sf_dir).select(
        "event_id",
        F.size(out).alias("n_headers"),
        F.array_join(pairs, ",").alias("headers"),
    )


@query
def header_encode(spark, sf_dir):
    encoded = hd.header_encode("text")
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(encoded).alias("digest"),
        F.length(encoded).cast("bigint").alias("n_bytes"),
    )


@query
def json_or_raw(spark, sf_dir):
    texts = tb.result_texts(tb.table(spark, sf_dir, "events"))
    return texts.select(
        "event_id",
        pl.json_or_raw("value").alias("parsed"),
        pl.json_boolean("value").alias("flag"),
    )


@query
def json_or_raw_text(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(pl.json_or_raw("text").cast("binary")).alias("digest"),
        pl.parsed_json("text").isNotNull().alias("is_json"),
    )


@query
def correlation_id(spark, sf_dir):
    events = _events(spark, sf_dir)
    millis = F.floor(epoch_micros(events, "ts") / 1000).cast("bigint")
    return events.select("event_id", pl.correlation_id(millis, "event_id").alias("cid"))


@query
def parse_int_prefix(spark, sf_dir):
    return tb.table(spark, sf_dir, "events").select(
        "event_id",
        pl.parse_int_prefix(F.concat("event_id", "event_type")).alias("leading"),
        pl.parse_int_prefix("props").alias("not_a_number"),
        pl.parse_int_prefix(F.substring_index("props", ":", -1)).alias("inner_number"),
        pl.parse_int_prefix(F.concat(F.lit("-"), "value")).alias("signed"),
    )


@query
def reply_envelope(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(
        "cid", "ok", pl.reply_envelope("ok", "result").alias("reply")
    )


# Correlation


def _sides(spark, sf_dir):
    events = _events(spark, sf_dir)
    return tb.requests(events), tb.replies(events)


def _outcomes(spark, sf_dir, **options) -> DataFrame:
    return co.reply_roundtrip(*_sides(spark, sf_dir), **options)


@query
def reply_match(spark, sf_dir):
    matched = co.reply_match(*_sides(spark, sf_dir))
    return _addressed(matched).withColumn("ts", F.date_format("ts", STAMP))


@query
def reply_timeouts(spark, sf_dir):
    return co.reply_timeouts(*_sides(spark, sf_dir)).select("cid", "inst")


@query
def reply_first_wins(spark, sf_dir):
    first = co.reply_first_wins(*_sides(spark, sf_dir))
    return _addressed(first).drop("ts")


@query
def reply_roundtrip(spark, sf_dir):
    return _addressed(_outcomes(spark, sf_dir)).drop("ts")


@query
def reply_one_off(spark, sf_dir):
    outcomes = _outcomes(spark, sf_dir, timeout_seconds=10, match_instance=False)
    return _addressed(outcomes).drop("ts")


@query
def reply_roundtrip_stream(spark, sf_dir):
    session = streaming_session(spark)
    events = tb.zoned(tb.table(session, sf_dir, "events"))
    outcomes = replay_roundtrip(
        tb.requests(events), tb.replies(events), scratch_path(spark, "roundtrip")
    )
    return outcomes.drop("ts")


def _live_outcomes(spark, sf_dir, label: str) -> DataFrame:
    events = tb.zoned(tb.table(streaming_session(spark), sf_dir, "events"))
    return replay_outcomes(
        tb.requests(events),
        tb.replies(events),
        scratch_path(spark, label),
        pack_rows=PACK_ROWS,
    )


@query
def reply_outcomes_live(spark, sf_dir):
    return _live_outcomes(spark, sf_dir, "live-outcomes").drop("ts")


@query
def reply_timeouts_live(spark, sf_dir):
    outcomes = _live_outcomes(spark, sf_dir, "live-timeouts")
    return outcomes.where(~F.col("ok")).select("cid", "inst")


# Counters and metrics


@query
def visit_count(spark, sf_dir):
    session = streaming_session(spark)
    checkpoint = f"{scratch_path(spark, 'visits')}/checkpoint"
    visits = tb.visits(tb.table_stream(session, sf_dir, "events", TRIGGER_BYTES))
    counts.count_visits(visits, checkpoint)
    return counts.read_visits(session, checkpoint)


@query
def visit_number(spark, sf_dir):
    numbered = ct.visit_number(
        tb.visits(_events(spark, sf_dir)),
        scratch_path(spark, "visit-slices"),
        order=("ts", "event_id"),
    )
    return numbered.select("page", "event_id", "visit")


@query
def visit_count_resume(spark, sf_dir):
    session = streaming_session(spark)
    folder = scratch_path(spark, "visits-resumed")
    visits = tb.visits(_events(spark, sf_dir))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for arrived in (visits.where(early), visits.where(~early)):
        arrived.write.mode("append").parquet(f"{folder}/visits")
        stream = topics.file_topic(session, f"{folder}/visits", visits.schema)
        counts.count_visits(stream, f"{folder}/checkpoint")
    return counts.read_visits(session, f"{folder}/checkpoint")


@query
def visit_number_live(spark, sf_dir):
    """Visits that arrive in two runs of one checkpoint."""
    session = streaming_session(spark)
    folder = scratch_path(spark, "visits-numbered")
    visits = tb.visits(_events(spark, sf_dir))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for arrived in (visits.where(early), visits.where(~early)):
        arrived.write.mode("append").parquet(f"{folder}/visits")
        stream = topics.file_topic(session, f"{folder}/visits", visits.schema)
        finished(counts.number_visits(stream, folder, order=("ts", "event_id")))
    return counts.numbered_visits(session, folder).select("page", "event_id", "visit")


@query
def metric_latest(spark, sf_dir):
    latest = mt.metric_latest(tb.samples(_events(spark, sf_dir)))
    return latest.select(
        "name",
        F.col("labels")["user"].alias("user"),
        F.date_format("ts", STAMP).alias("ts"),
        "value",
    )


@query
def metric_selector(spark, sf_dir):
    latest = mt.metric_latest(
        tb.samples(_events(spark, sf_dir)), "purchase", {"user": "7"}
    )
    return latest.select("name", F.col("labels")["user"].alias("user"), "value")


@query
def topic_backlog(spark, sf_dir):
    requests, results = _sides(spark, sf_dir)
    backlog = co.topic_backlog(requests, results, F.to_date("ts"))
    return backlog.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query
def topic_backlog_live(spark, sf_dir):
    """What a stopped consumer is behind once the second half of the month has landed."""
    session = streaming_session(spark)
    folder = scratch_path(spark, "backlog")
    requests = tb.requests(_events(spark, sf_dir))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    requests.where(early).write.parquet(f"{folder}/topic")
    with ProgressLog(session, f"{folder}/progress") as log:
        stream = topics.file_topic(session, f"{folder}/topic", requests.schema)
        log.wait(run_available(stream, f"{folder}/checkpoint"))
    requests.where(~early).write.mode("append").parquet(f"{folder}/topic")
    landed = spark.read.schema(requests.schema).parquet(f"{folder}/topic").count()
    behind = live_backlog(session, f"{folder}/progress", landed)
    return behind.groupBy("query").agg(
        F.max("received").alias("received"), F.min("backlog").alias("backlog")
    ).drop("query")
