"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional
rank is its rank over the source's rows. Sorted by fractional rank the sources
interleave in proportion, so any cut of the order has the mixture of the whole. The
order is cut into shards of equal numbers of rows.

Ranks come from counts: rows fall into bins by the first digits of their hash, a bin's
offset is the sum of the counts of the bins before it, and only the rows of one bin
are sorted together. Neither a large source nor the whole order meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import written

# Hash digits that make a bin of a source, and bins of the whole order.
BIN_DIGITS = 3
BINS = 4096


def _before(counts: DataFrame, group: Sequence[str], bin_: str) -> DataFrame:
    """Rows in the bins before, and in all, of each group."""
    upto = (
        Window.partitionBy(*group)
        .orderBy(bin_)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))


def interleaved(
    docs: DataFrame,
    shards: int,
    source: str,
    keys: Sequence[str],
    seed: int = 0,
    bins: int = BINS,
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and its place ``slot`` there.

    ``keys`` tell rows apart and, with the seed, fix the order. Shards differ by at
    most one row, and by at most about one row per source in what they hold of a
    source. Null sources form a source of their own, null keys count as empty; rows
    equal in all keys come in any order among themselves. Columns ``shard`` and
    ``slot`` of ``docs`` are replaced; other columns, whatever their names, are kept.
    Fewer rows than shards leave some shards empty; an empty table gives none.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *texts))
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias(
            "_source"
        ),
        digest.alias("_hash"),
        F.concat_ws("\x1f", *texts).alias("_key"),
    ).withColumn("_bin", F.substring("_hash", 1, BIN_DIGITS))
    per_bin = rows.groupBy("_source", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(per_bin, ["_source"], "_bin").withColumn(
        "_all", F.sum("_n").over(Window.partitionBy("_source"))
    )
    by_hash = Window.partitionBy("_source", "_bin").orderBy("_hash", "_key")
    ranked = written(
        rows.join(offsets, ["_source", "_bin"])
        .withColumn("_rank", F.row_number().over(by_hash) + F.col("_before"))
        .withColumn("_part", (2 * F.col("_rank") - 1) / (2 * F.col("_all")))
        .withColumn("_bin", F.floor(F.col("_part") * bins).cast("int"))
        .select("_row", "_source", "_hash", "_key", "_part", "_bin"),
        "interleave",
    )
    # One row a bin: BINS rows at most meet here, whatever the data.
    per_bin = ranked.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(per_bin, [], "_bin").withColumn(
        "_total", F.sum("_n").over(Window.partitionBy())
    )
    order = Window.partitionBy("_bin").orderBy("_part", "_hash", "_key", "_source")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return (
        ranked.join(F.broadcast(offsets.select("_bin", "_before", "_total")), "_bin")
        .withColumn("_at", F.row_number().over(order) - 1 + F.col("_before"))
        .withColumn("shard", F.expr(f"(_at * {shards}) div _total").cast("int"))
        .select("_row.*", "shard", (F.col("_at") - first).cast("bigint").alias("slot"))
    )


def write_shards(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write rows that have ``shard`` and ``slot`` as one folder per shard, each
    sorted by slot."""
    (
        rows.select("shard", "slot", *columns)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")
