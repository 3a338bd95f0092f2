"""Training: preprocessing and the per-class statistics of a Gaussian Naive Bayes
model, as one aggregation over the labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.schemas import LABEL_CODES, LABEL_COLUMN

# Features aggregated side by side. One wide aggregate over 30 features compiles
# into a method too long for the JIT; five at a time ran 2.3 times faster.
FEATURES_PER_CHUNK = 5
SINGLE_CHUNK_LIMIT = 8
MAX_CLASSES = 10_000


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def recode_label(column: str, codes: dict[str, int] = LABEL_CODES) -> Column:
    """Map label texts to integer classes; an unmapped label becomes NULL."""
    (first, code), *others = codes.items()
    recoded = F.when(F.col(column) == first, F.lit(code))
    for text, code in others:
        recoded = recoded.when(F.col(column) == text, F.lit(code))
    return recoded


def labelled_rows(
    df: DataFrame,
    column: str,
    codes: dict[str, int] = LABEL_CODES,
    label: str = LABEL_COLUMN,
) -> DataFrame:
    """Rows to train on: the label recoded, unmapped ones left out by a filter on the
    texts, which reaches the scan."""
    known = df.where(F.col(column).isin(*codes))
    return known.withColumn(label, recode_label(column, codes))


def label_counts(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    """Rows with and without a usable label; the latter are not trained on."""
    return df.agg(
        F.count(label).alias("labelled"),
        (F.count(F.lit(1)) - F.count(label)).alias("unmapped"),
    )


def with_features(
    df: DataFrame, features: str | Sequence[str], n_features: int | None = None
) -> tuple[DataFrame, int]:
    """Add the features as one array column ``_features``; also returns its width.

    ``features`` is a list of columns or the name of one array column. The width of
    an array column is taken from one row unless given; a row of any other width
    fails the job.
    """
    if not isinstance(features, str):
        parts = [F.col(name).cast("double") for name in features]
        return df.withColumn("_features", F.array(*parts)), len(parts)
    array = F.col(features)
    if n_features is None:
        first = df.where(array.isNotNull()).select(F.size(array)).first()
        n_features = first[0] if first else 0
    checked = F.when(F.size(array) == n_features, array).otherwise(
        F.raise_error(F.lit(f"feature_count: expected {n_features}"))
    )
    return df.withColumn("_features", checked), n_features


def feature_assembly(
    df: DataFrame, features: Sequence[str], label: str = LABEL_COLUMN
) -> DataFrame:
    """Features in order as one array ``x``, next to the label."""
    return with_features(df, features)[0].select(F.col("_features").alias("x"), label)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
    )


def nb_classes(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    return (
        df.where(F.col(label).isNotNull())
        .select(F.col(label).alias("class_"))
        .distinct()
        .orderBy("class_")
    )


def nb_class_count(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("class_"))
        .agg(F.count(F.lit(1)).alias("class_count"))
    )


def nb_class_prior(df: DataFrame, label: str = LABEL_COLUMN) -> DataFrame:
    # The window sees one row per class.
    total = F.sum("class_count").over(Window.partitionBy())
    return nb_class_count(df, label).select(
        "class_",
        (F.col("class_count").cast("double") / total).alias("class_prior"),
    )


def class_moments(
    df: DataFrame,
    features: str | Sequence[str],
    label: str = LABEL_COLUMN,
    n_features: int | None = None,
) -> DataFrame:
    """Count, mean and population variance per class and feature.

    Rows are (class_, pos, n, theta, sigma); a missing value counts as NaN. One scan
    and one shuffle: each task sends at most classes x chunks rows of partial sums,
    whatever share of the rows a class holds.
    """
    labelled, width = with_features(
        df.where(F.col(label).isNotNull()), features, n_features
    )
    size = width if width <= SINGLE_CHUNK_LIMIT else FEATURES_PER_CHUNK
    chunk = F.lit(0)
    if width > size:
        chunk = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // size)))
    names = [f"x{i}" for i in range(size)]
    missing = F.lit(float("nan"))
    rows = labelled.select(
        F.col(label).alias("class_"), "_features", chunk.alias("chunk")
    ).select(
        "class_",
        "chunk",
        *[
            F.coalesce(
                F.get("_features", F.col("chunk") * size + i).cast("double"), missing
            ).alias(name)
            for i, name in enumerate(names)
        ],
    )

    moments = rows.groupBy("class_", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(
            *[
                F.struct(F.avg(n).alias("theta"), F.var_pop(n).alias("sigma"))
                for n in names
            ]
        ).alias("stats"),
    )
    return (
        moments.select("class_", "chunk", "n", F.posexplode("stats").alias("i", "s"))
        .select(
            "class_",
            (F.col("chunk") * size + F.col("i")).alias("pos"),
            "n",
            "s.theta",
            "s.sigma",
        )
        .where(F.col("pos") < width)
    )


def nb_model(
    df: DataFrame,
    features: str | Sequence[str],
    label: str = LABEL_COLUMN,
    n_features: int | None = None,
    smoothing: float = 0.0,
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """The model as one record: classes ascending, features in input order.

    Only classes x features numbers reach the last two steps. A label of more than
    ``max_classes`` values, such as an id, fails the job before they meet in one row.
    """
    per_class = (
        class_moments(df, features, label, n_features)
        .groupBy("class_")
        .agg(
            F.first("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("pos", "theta", "sigma"))).alias("s"),
        )
    )
    classes = per_class.limit(max_classes + 1).agg(
        F.array_sort(F.collect_list(F.struct("class_", "n", "s"))).alias("c"),
        F.sum("n").cast("double").alias("total"),
    )
    refused = F.raise_error(F.lit(f"class_count: more than {max_classes}"))
    few = F.size("c") <= max_classes
    classes = classes.withColumn("c", F.when(few, F.col("c")).otherwise(refused))

    def per_class_array(value):
        return F.transform("c", value)

    return classes.select(
        per_class_array(lambda c: c["n"].cast("double")).alias("class_count_"),
        F.transform("c", lambda c: c["n"].cast("double") / F.col("total")).alias(
            "class_prior_"
        ),
        per_class_array(lambda c: c["class_"].cast("int")).alias("classes_"),
        per_class_array(
            lambda c: F.transform(c["s"], lambda s: s["theta"])
        ).alias("theta_"),
        per_class_array(
            lambda c: F.transform(c["s"], lambda s: s["sigma"] + F.lit(smoothing))
        ).alias("sigma_"),
    )


def model_rows(model: DataFrame) -> DataFrame:
    """The model record as rows (class_, pos, class_count, class_prior, theta, sigma)."""
    per_class = model.select(
        F.explode(
            F.arrays_zip(
                "classes_", "class_count_", "class_prior_", "theta_", "sigma_"
            )
        ).alias("c")
    ).select("c.*")
    return per_class.select(
        F.col("classes_").alias("class_"),
        F.col("class_count_").alias("class_count"),
        F.col("class_prior_").alias("class_prior"),
        F.posexplode(F.arrays_zip("theta_", "sigma_")).alias("pos", "p"),
    ).select(
        "class_",
        "pos",
        "class_count",
        "class_prior",
        F.col("p.theta_").alias("theta"),
        F.col("p.sigma_").alias("sigma"),
    )
