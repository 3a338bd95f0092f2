"""Files in a data lake: any path Spark can open, s3a:// included."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewheel.schemas import training_schema


def object_store_options(
    endpoint: str, path_style: bool = True, provider: str | None = None
) -> dict[str, str]:
    """Reader options for an S3-compatible store. Keys come from the cluster's
    credentials provider, never from code."""
    options = {
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.path.style.access": str(path_style).lower(),
        "fs.s3a.connection.ssl.enabled": str(endpoint.startswith("https")).lower(),
    }
    if provider:
        options["fs.s3a.aws.credentials.provider"] = provider
    return options


def csv_named_scan(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Headerless CSV with the given names and types; no pass to infer them."""
    return (
        spark.read.options(**dict(options or {}))
        .schema(schema or training_schema())
        .csv(path if isinstance(path, str) else list(path), header=False)
    )


def lake_listing(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Path, size and time of every object; contents are not read."""
    reader = spark.read.options(**dict(options or {})).format("binaryFile")
    reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def lake_show(
    spark: SparkSession, path: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """An object's lines."""
    return spark.read.options(**dict(options or {})).text(path)


def lake_ingest(
    spark: SparkSession,
    source: str,
    landing: str,
    name: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Put a raw text file into the landing path as the object ``name``, or the source's
    own name, and return its lines there. An object of that name is replaced, others stay.

    The file is copied in parallel, line by line: its bytes are kept, carriage returns
    included, but for a line end after a last line that has none. The lines are staged
    beside the landing path and take the old object's place when all are written, so a
    job that fails on the way or runs again leaves one whole copy.
    """
    given = dict(options or {})
    landing = landing.rstrip("/")
    name = name or source.rstrip("/").rpartition("/")[2]
    target = f"{landing}/{name}"
    staged = f"{landing}.staged/{uuid.uuid4().hex}"
    lines = spark.read.options(**given).option("lineSep", "\n").text(source)
    lines.write.options(**given).option("lineSep", "\n").text(f"{staged}/new")
    _replace(spark, staged, target, given)
    return spark.read.options(**given).text(target)


def _replace(spark: SparkSession, staged: str, target: str, options: Mapping) -> None:
    """Move ``staged``/new to ``target``; what was there moves aside first and then goes."""
    hadoop = spark._jvm.org.apache.hadoop
    settings = hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for key, value in options.items():
        settings.set(key, str(value))
    files = hadoop.fs.Path(target).getFileSystem(settings)
    place, new, old, all_of_it = (
        hadoop.fs.Path(p) for p in (target, f"{staged}/new", f"{staged}/old", staged)
    )
    files.mkdirs(place.getParent())
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"cannot move {target} aside")
    if not files.rename(new, place):
        raise OSError(f"cannot move {staged}/new to {target}")
    files.delete(all_of_it, True)
