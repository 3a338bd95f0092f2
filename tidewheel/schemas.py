"""Schemas of the tables, files and messages the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The layout of the headerless training file and its label codes.
ID_COLUMN = "id"
LABEL_COLUMN = "target"
N_FEATURES = 30
LABEL_CODES = {"M": 1, "B": 0}

# Topics, header names and reply settings of the message contract.
REQUEST_TOPIC = "tracking-data"
RESULT_TOPIC = "model-results"
CORRELATION_HEADER = "correlationId"
INSTANCE_HEADER = "instanceId"
CLIENT_ID = "consumer-id"
REPLY_TIMEOUT_SECONDS = 15
ONE_OFF_TIMEOUT_SECONDS = 10
REPLY_ERROR = "Failed to send or receive from Kafka"

# Names of the form's 30 inputs, in input order.
FORM_FIELDS = [
    "radius1",
    "texture1",
    "perimeter1",
    "area1",
    "smoothness1",
    "compactness1",
    "concavity1",
    "concave_points1",
    "symmetry1",
    "fractal_dimension1",
    "radius2",
    "texture2",
    "perimeter2",
    "area2",
    "smoothness2",
    "compactness2",
    "concavity2",
    "concave_points2",
    "symmetry2",
    "fractal_dimension2",
    "radius3",
    "texture3",
    "perimeter3",
    "area3",
    "smoothness3",
    "compactness3",
    "concavity3",
    "concave_points3",
    "symmetry3",
    "fractal_dimension3",
]

FEATURE_COLUMNS = [f"feature_{i}" for i in range(1, N_FEATURES + 1)]
LOAD_FIELDS = [f"f{i}" for i in range(N_FEATURES)]


def training_schema(
    features: list[str] | None = None, id_column: str | None = ID_COLUMN
) -> T.StructType:
    """Schema of a headerless training file: id, text label, then features."""
    fields = [T.StructField(id_column, T.LongType())] if id_column else []
    fields.append(T.StructField(LABEL_COLUMN, T.StringType()))
    fields += [T.StructField(f, T.DoubleType()) for f in features or FEATURE_COLUMNS]
    return T.StructType(fields)


MODEL_SCHEMA = T.StructType(
    [
        T.StructField("class_count_", T.ArrayType(T.DoubleType())),
        T.StructField("class_prior_", T.ArrayType(T.DoubleType())),
        T.StructField("classes_", T.ArrayType(T.IntegerType())),
        T.StructField("theta_", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("sigma_", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)

HEADERS_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
    )
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", HEADERS_TYPE),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
