"""The given tables in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.headers import header, header_encode
from tidewheel.functions.scoring import Model, load_model
from tidewheel.operators.training import labelled_rows, nb_model, recode_label
from tidewheel.schemas import CORRELATION_HEADER, FEATURE_COLUMNS, INSTANCE_HEADER
from tidewheel.sources.topics import file_topic

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CODES = {"R": 1, "A": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, max_bytes: int | None = None
) -> DataFrame:
    """The stored table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return file_topic(spark, f"{sf_dir}/{name}.parquet*", schema, max_bytes)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled table: four features and a label with one unmapped value."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "target", recode_label("l_returnflag", LINE_CODES)
    )


def wide_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with 30 features: six measures, each as it is, squared, as a root,
    as the distance from ten, and times the quantity."""
    lines = line_rows(spark, sf_dir)
    measures = [
        *[F.col(f).cast("double") for f in LINE_FEATURES],
        F.date_diff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double"),
        F.month("l_shipdate").cast("double"),
    ]
    columns = {}
    for x in measures:
        forms = (x, x * x, F.sqrt(F.abs(x)), F.abs(x - 10), x * F.col("l_quantity"))
        for form in forms:
            columns[FEATURE_COLUMNS[len(columns)]] = form.cast("double")
    return lines.withColumns(columns)


def line_model_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return nb_model(labelled_rows(lines, "l_returnflag", LINE_CODES), LINE_FEATURES)


def line_model(spark: SparkSession, sf_dir: str) -> Model:
    return load_model(line_model_record(spark, sf_dir))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array features and ten classes."""
    return table(spark, sf_dir, "embeddings")


def embedding_model_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_model(embedding_rows(spark, sf_dir), "embedding", "label")


def embedding_model(spark: SparkSession, sf_dir: str) -> Model:
    return load_model(embedding_model_record(spark, sf_dir))


def line_messages(lines: DataFrame) -> DataFrame:
    """Lines as request messages, labelled or not, table or stream alike. Values are texts;
    the header ``x`` is one that must not be forwarded."""
    cid = F.concat_ws("-", F.lit("c"), "l_orderkey", "l_linenumber")
    names = ["a", "b", "c", "d"]
    texts = [F.col(f).cast("string").alias(n) for f, n in zip(LINE_FEATURES, names)]
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.to_json(F.struct(*texts)).cast("binary").alias("value"),
        F.array(
            header(CORRELATION_HEADER, header_encode(cid)),
            header("x", F.lit("T").cast("binary")),
        ).alias("headers"),
    )


def header_messages(events: DataFrame) -> DataFrame:
    """Events with every kind of header list: plain, with a repeated name, with one
    missing, with a missing value, and none at all."""
    first = F.concat(F.lit("c-"), F.col("event_id"))
    second = F.concat(F.lit("r-"), F.col("event_id"))
    correlation = header(CORRELATION_HEADER, header_encode(first))
    again = header(CORRELATION_HEADER, header_encode(second))
    absent = header(CORRELATION_HEADER, F.lit(None))
    instance = header(
        INSTANCE_HEADER, header_encode((F.col("user_id") % 3).cast("string"))
    )
    trace = header("trace", F.lit("T").cast("binary"))
    kind = F.col("event_type")
    return events.withColumn(
        "headers",
        F.when(kind == "purchase", F.array(correlation, trace, instance))
        .when(kind == "view", F.array(instance, correlation, again))
        .when(kind == "signup", F.array(trace, correlation))
        .when(kind == "click", F.array(correlation, absent, instance)),
    )


def requests(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") != "error").select(
        F.col("event_id").cast("string").alias("cid"),
        (F.col("user_id") % 3).alias("inst"),
        "ts",
    )


def replies(events: DataFrame) -> DataFrame:
    """Some requests get no reply, some two, some a late one, and some replies
    belong to no request."""
    kind, number = F.col("event_type"), F.col("event_id")

    def answer(rows: DataFrame, delay: int) -> DataFrame:
        seconds = number * 7 % 30 + delay
        return rows.select(
            number.cast("string").alias("cid"),
            (F.col("user_id") % 3).alias("inst"),
            (F.col("value") > 100).alias("result"),
            (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("reply_ts"),
        )

    once = events.where((kind != "error") & (number % 11 != 0))
    again = events.where((number % 13 == 0) & (kind != "signup"))
    return answer(once, 0).unionByName(answer(again, 3))


def zoned(events: DataFrame) -> DataFrame:
    """Event time with a zone, which watermarks need; the session's zone is UTC."""
    return events.withColumn("ts", F.col("ts").cast(T.TimestampType()))


def visits(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("page"), "ts", "event_id")


def samples(events: DataFrame) -> DataFrame:
    """Events as metric samples, one series per type and user."""
    return events.select(
        F.col("event_type").alias("name"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        "ts",
        "value",
    )


def result_texts(events: DataFrame) -> DataFrame:
    """Result messages: JSON booleans, a JSON object, raw text and no value."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.when(kind == "view", (F.col("value") > 100).cast("string"))
        .when(kind == "click", F.col("props"))
        .when(kind == "signup", F.concat_ws(" ", "user_id", "event_type"))
        .when(kind == "purchase", F.concat(F.lit("oops "), F.col("props")))
        .cast("binary")
        .alias("value"),
    )
