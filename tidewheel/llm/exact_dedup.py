"""Exact dedup: sorted runs of digests, merged in rounds along a tree.

Built-in functions only. A run holds the distinct digests of one partition with their
counts and smallest ids. In a round, groups of ``WAYS`` runs exchange their entries: an
entry goes where a digit of its digest says, and the runs that meet there are merged.
A digit of the run's number is settled by each round, so after the last an entry's
place follows from its digest alone and equal texts have met. What was found then goes
back down the same tree to the runs. A digest meets at most ``WAYS`` entries of its own
at any place of any round, however many copies it has.

Entries are placed by a 64-bit hash and told apart, at every level, by SHA-256 and
length of the normalised text: texts whose short hashes agree by chance stay apart. Two
different texts would need equal SHA-256 and equal length to be taken for one.

Defined results: a null text counts as empty. Of equal texts the row with the smallest
id stays, an id before none; of rows that repeat an id as well exactly one stays. An
empty table gives an empty one. Columns of the documents beside id and text are not read,
so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import text_or_empty, written

# Runs merged at one place in a round.
WAYS = 16
IDENTITY = ["place", "short", "sha", "size"]


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space as one space."""
    plain = F.translate(text_or_empty(text), "\t\n\x0b\f\r", "     ")
    return F.regexp_replace(plain, "  +", " ")


def digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row, id, run, short, sha, size) of every row, written: the run is the partition
    that wrote the row, and stays so when a task is repeated later."""
    hashed = docs.select(
        F.col(f"`{id_col}`").alias("id"), normalised(f"`{text}`").alias("text")
    )
    return written(
        hashed.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.spark_partition_id().cast("bigint").alias("run"),
            F.xxhash64("text").alias("short"),
            F.unhex(F.sha2("text", 256)).alias("sha"),
            F.octet_length("text").cast("bigint").alias("size"),
        ),
        "digests",
    )


def _digit(number: Column, level: int) -> Column:
    return F.pmod(F.shiftright(number, 4 * level), F.lit(WAYS))


def _moved(level: int) -> Column:
    """The place after a round: one digit of the old place becomes that of the digest."""
    old, new = _digit(F.col("place"), level), _digit(F.col("short"), level)
    return F.col("place") + F.shiftleft(new - old, 4 * level)


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*IDENTITY).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def exact_groups(rows: DataFrame) -> DataFrame:
    """``rows`` of ``digests`` with ``least`` (none, id, row) of each group and its size."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    runs = rows.select(
        F.col("run").alias("place"), "short", "sha", "size", rank.alias("least"), F.lit(1).cast("bigint").alias("n")
    )
    highest = rows.agg(F.max("run")).first()[0] or 0
    rounds = 0
    while highest >= WAYS**rounds:
        rounds += 1
    levels = [written(_merged(runs), "runs-0")]
    for level in range(rounds):
        exchanged = levels[-1].withColumn("place", _moved(level))
        levels.append(written(_merged(exchanged), f"runs-{level + 1}"))
    found = levels.pop()
    for level in reversed(range(rounds)):
        found = _told(levels.pop().withColumn("up", _moved(level)), found)
    return rows.withColumn("place", F.col("run")).join(found, IDENTITY).drop("place")


def _told(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of a level with what was found at the level above."""
    above = found.withColumnRenamed("place", "up")
    return entries.drop("least", "n").join(above, ["up", *IDENTITY[1:]]).drop("up")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    grouped = exact_groups(digests(docs, id_col, text))
    return grouped.select(
        F.col("id").alias(id_col),
        F.col("least.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
