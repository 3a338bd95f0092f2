"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import contamination, exact_dedup, jaccard_join, line_dedup, packing
from tidewheel.llm import quality, secret_scan, sharding, spelling, substring_dedup
from tidewheel.llm import token_counts as tokens
from tidewheel.llm import toxicity, whitening
from tidewheel.llm.common import crc32_of, public_path, table, text_or_empty


def held_out() -> Column:
    """Rows whose labels nothing is learnt from."""
    remainder = F.pmod(crc32_of(F.col("doc_id").cast("string")), F.lit(3))
    return F.coalesce(remainder == 1, F.lit(False))


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", "predicted"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        sharding.size_of(F.col("text")).alias("size"),
        crc32_of(text_or_empty("text")).alias("text_crc32"),
    )
    placed = sharding.interleaved(docs, 40, "source", ["doc_id", "text_crc32"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_fertility_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.fertility_quality(docs, public_path("piece_bpe_32k.model"))
    return judged.drop("lang", "text")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


def _of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def op6_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("secrets")
    kinds = [known.kind for known in secret_scan.KNOWN]
    base = F.filter(found, lambda s: s["rank"] < len(kinds))
    return secret_scan.secret_spans(docs).select(
        "doc_id",
        *[_of_kind(found, kind).alias(f"n_{kind}") for kind in kinds],
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
        secret_scan.span_list(found).alias("spans"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.packed_documents(docs, public_path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select(
        "doc_id", "n_shingles", "component_id"
    )


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    cleaned = line_dedup.drop_boilerplate(
        pages,
        line_dedup.host_of(F.col("url")),
        line_dedup.html_lines(F.col("html")),
    )
    return cleaned.select(
        "page_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


def op10_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(docs).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, sf_dir, "embeddings"), components=4)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pu_toxicity,
        op2_token_counts,
        op3_interleaved_shards,
        op4_fertility_quality,
        op5_benchmark_leaks,
        op6_entropy_secrets,
        op7_best_fit_packing,
        op8_jaccard_join,
        op9_site_lines,
        op10_fm_index_dedup,
        op11_spelling_variants,
        op12_exact_dedup,
        op13_embedding_whitening,
    )
}
