"""The corpus pipeline: stages over the documents, each written before the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import contamination, jaccard_join, line_dedup, packing, quality
from tidewheel.llm.common import public_path, table, written


# The columns that stages read; all others only pass through.
READ = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage, for documents with any further columns: these take part under names that
    no operator uses, and get their own back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"_passed{i}" for i, c in enumerate(docs.columns)]
        own = dict(zip(names, docs.columns))
        found = stage(spark, docs.toDF(*names), sf_dir)
        return found.toDF(*[own.get(c, c) for c in found.columns])

    return run_stage


@any_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go, as they have no words; rows
    that repeat are judged alike; no documents give none."""
    judged = quality.fertility_quality(docs, public_path("piece_bpe_32k.model"))
    return judged.where("kept").select(*docs.columns)


@any_columns
def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate of their source. Copies are for the
    next stage to judge: equal texts of a source count once, and a document that would
    lose most of its words stays whole. Every row stays; one without a source or a text is
    left as it is."""
    return line_dedup.without_boilerplate(docs, "source", "text")


@any_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the least id, null ids last, and
    one of rows that repeat. Documents without words stay."""
    return jaccard_join.one_of_each(docs)


@any_columns
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are told apart by id and text, so
    a leak takes its own copies with it and no other row of its id; null texts stay."""
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    hits = contamination.contaminated(
        keyed, table(spark, sf_dir, "benchmark"), keys=["doc_id", "text_key"]
    )
    gone = hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    return keyed.join(gone.distinct(), same, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and places. A null or empty text is
    one piece of the end token; other columns are not read."""
    return packing.packed_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", site_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
