"""Similarity join on word shingles by prefixes and token combinations.

A document's set is its distinct five-word shingles, here called tokens. In an order of
all tokens by hash, two sets of Jaccard similarity t or more share a token among the
first ``n - ceil(t * n) + 1`` of each. Prefixes are made longer by ``extension(n)``, so
that as many are shared at least; a set with fewer tokens of its prefix in other sets goes,
and of the rest one with too little of its whole set in others. The extension is more than the
number of cells that frequent tokens fall into, so for each pair either a rare token is shared, or two frequent tokens of one
cell: rare tokens are indexed one by one, and frequent ones by combinations of two
within their cell. Candidates are verified on whole sets.

Equal sets are one from the start. Only links between different groups matter for the
components, so before pairs are made each set is verified against one member of its
buckets, the one it shares most tokens with, and what links is one group. A set goes on only
if as much of it as a link asks for is in sets of other groups; candidates are
then sought across groups alone. How frequent a token is, is counted in groups. Sets are
verified in families of sets that hang together by such candidates: the sets of two blocks
of a family are judged at once by products of matrices, so a large group of edited copies
costs a pair of blocks where it would cost a quarter of a million pairs. Signatures are
held against each other across families.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import (
    BROADCAST_BYTES,
    ROWS,
    WORD,
    lean,
    octets,
    release,
    small_batches,
    written,
)
from tidewheel.llm.components import components
from tidewheel.llm.pruning import KeyFilter, known
from tidewheel.llm.words import Words, word_ranges

WIDTH = 5
PERCENT = 80
CELLS = 4
# A token in more groups than this is frequent.
FREQUENT = 32
# One more token to be shared for so many in the set.
EXTEND_BY = 16
# Rows that may be broadcast, within BROADCAST_BYTES.
BROADCAST_ROWS = 4_000_000
# Keys of sets: a quarter of that, as in memory they are several times as long.
KEYS = 4
# Blocks of 8 bytes of a filter of tokens, at most.
FILTER_BLOCKS = BROADCAST_BYTES // 8
# Sets of under so many tokens have CELLS cells; beyond, cells grow with the extension.
FEW_TOKENS = 6 * EXTEND_BY
# Tokens and sets that are loaded together to be verified, and rows and columns of a matrix.
BLOCK_TOKENS = 1 << 20
BLOCK_SETS = 4096
STRIP = 512
COLUMNS = 2048
# Parts of the blocks, by pairs of which candidates are verified: so many at least, and
# more where one would hold more tokens than this.
GROUPS = 32
GROUP_TOKENS = 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes, cache: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text. Case is that of A-Z only;
    fewer words than ``width`` are one shingle, none are none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    return np.unique(_runs(hashes, min(n, width)))


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    many = max(len(hashes) - size + 1, 0)
    mixed = np.full(many, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + many]) * _FACTOR
        mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(29)
    return mixed


def shingle_sets(words: Words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """``shingles`` of each of many texts, by hashes of their own."""
    hashes = words.lowered().hashes()
    mixed = _runs(hashes, width)
    for first, n in zip(words.firsts().tolist(), words.counts.tolist()):
        if n >= width:
            yield np.unique(mixed[first : first + n - width + 1])
        else:
            yield _runs(hashes[first : first + n], n) if n else np.zeros(0, np.uint64)


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def extension(n: int) -> int:
    return max(1 + CELLS, n // EXTEND_BY)


def _small(rows: DataFrame, share: int = 1) -> DataFrame:
    """The rows, to be broadcast if they are few and small enough, that is within one of
    ``share`` parts of the bound; else Spark shuffles them."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(octets(rows))).first()
    few = n <= BROADCAST_ROWS // share and (size or 0) <= BROADCAST_BYTES // share
    return F.broadcast(rows) if few else rows


def _sets(docs: DataFrame, percent: int, width: int, whole: bool) -> DataFrame:
    """Of rows (id, text): id, place, n, digest of the set, and the set itself or its
    extended prefix. A set that only an equal one can link to needs no prefix."""
    schema = T.StructType(
        [
            docs.schema["id"],
            T.StructField("place", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("tokens", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in word_ranges(batch, "text"):
                sizes, digests, tokens = [], [], []
                for own in shingle_sets(words, width):
                    n = len(own)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    if not whole:
                        errors = n - _least_overlap(n, percent)
                        alone = percent * (n + 1) > 100 * n
                        own = own[: 0 if alone else errors + extension(n)]
                    tokens.append(own)
                offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(np.concatenate(tokens).view(np.int64))
                        ),
                    ],
                    names=schema.fieldNames(),
                )

    return docs.select("id", "place", "text").mapInArrow(lean(run), schema)


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sizes that can reach the similarity at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _families(sets: DataFrame, star: DataFrame) -> DataFrame:
    """The sets with the family of those that hang together by the pairs of ``star``."""
    families = components(star).withColumnsRenamed({"node": "digest", "root": "family"})
    named = sets.join(families, "digest", "left")
    return named.withColumn("family", F.coalesce("family", "digest"))


def _blocks(named: DataFrame) -> DataFrame:
    """(digest, family, block, part) of sets (digest, n, family): the sets of a family in
    blocks of about BLOCK_TOKENS tokens and BLOCK_SETS sets at most, so that candidates
    mostly lie within few blocks; blocks are dealt to parts of about GROUP_TOKENS."""
    tokens, members = F.sum("n") / BLOCK_TOKENS, F.count(F.lit(1)) / BLOCK_SETS
    sizes = named.groupBy("family").agg(F.ceil(F.greatest(tokens, members)).alias("parts"))
    total = named.agg(F.sum("n")).first()[0] or 0
    groups = max(GROUPS, -(-total // GROUP_TOKENS))
    nth = F.pmod(F.xxhash64("digest"), F.col("parts"))
    return (
        named.join(sizes, "family")
        .select("digest", "family", F.xxhash64("family", nth).alias("block"))
        .withColumn("part", F.pmod("block", F.lit(groups)))
    )


def verified(
    pairs: DataFrame, sets: DataFrame, blocks: DataFrame, percent: int
) -> DataFrame:
    """The pairs (a, b) of digests whose whole sets are similar enough. First halves of
    the tokens are held against each other, which can only find too many in common; the
    few pairs that are left are verified on the tokens."""
    halves = sets.withColumn(
        "tokens", F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int"))
    )
    maybe = written(_similar(pairs, halves, blocks, percent), "maybe-links")
    return _similar(maybe, sets, blocks, percent)


def _similar(
    pairs: DataFrame, sets: DataFrame, blocks: DataFrame, percent: int
) -> DataFrame:
    """Pairs that pass by their tokens. They are judged in groups of the same parts of
    the blocks on either side, to each of which a set travels once."""
    left = blocks.select(F.col("digest").alias("a"), F.col("part").alias("x"))
    right = left.withColumnsRenamed({"a": "b", "x": "y"})
    keyed = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "pairs")
    needed = (
        keyed.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("a").alias("digest"))
        .union(keyed.select("x", "y", "b"))
        .distinct()
    )
    # Few enough of them save a shuffle of whole sets.
    needed = _small(written(needed, "needed"), KEYS)

    def judge(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        # Tokens are sorted as numbers without a sign.
        known = {
            bytes(d): (n, np.asarray(t).view(f"u{np.asarray(t).itemsize}"))
            for d, n, t in zip(held["digest"], held["n"], held["tokens"])
        }
        links = []
        for a, b in zip(own["a"], own["b"]):
            (n, x), (m, y) = known[bytes(a)], known[bytes(b)]
            place = np.searchsorted(y, x)
            place[place == len(y)] = 0
            both = int((y[place] == x).sum())
            if 100 * both >= percent * (n + m - both):
                links.append((a, b))
        del known, held
        release()
        return pd.DataFrame(links, columns=["a", "b"])

    return (
        keyed.groupBy("x", "y")
        .cogroup(needed.join(sets, "digest").groupBy("u", "v"))
        .applyInPandas(judge, "a binary, b binary")
    )


def _least_shared(n: str, percent: int) -> Column:
    """Tokens of its prefix that a set of ``n`` shares with any it links to, if its
    prefix ends before the other's; the other's count holds if not."""
    overlap = f"(({percent} * {n} + 99) div 100)"
    return F.expr(f"least({overlap}, greatest({1 + CELLS}, {n} div {EXTEND_BY}))")


def _star_pairs(shared: DataFrame, percent: int, salt: int) -> DataFrame:
    """For each set that has a bucket with other groups, one member of another group:
    the one most of its buckets put forward."""
    member = F.struct(
        F.xxhash64(F.lit(salt), "root").alias("order"), "root", "digest", "n"
    )
    centres = shared.groupBy("token").agg(F.min(member).alias("c"))
    return (
        shared.join(centres, "token")
        .where((F.col("root") != F.col("c.root")) & _near(F.col("n"), F.col("c.n"), percent))
        .groupBy(F.col("digest").alias("a"), F.col("c.digest").alias("b"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    )


def _across_groups(shared: DataFrame, group: str = "root") -> DataFrame:
    """The rows of buckets that hold more than one group."""
    mixed = (
        shared.groupBy("token")
        .agg(F.min(group).alias("low"), F.max(group).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("token")
    )
    return shared.join(mixed, "token")


def _rank(n: Column) -> Column:
    """Class of sizes: 0 below FEW_TOKENS, one more from there on and at each doubling."""
    times = F.floor(n / FEW_TOKENS).cast("bigint")
    return F.when(n < FEW_TOKENS, 0).otherwise(F.length(F.bin(times)))


def _cells(rank: Column) -> Column:
    """Cells of a class: one less than the least extension of its sets."""
    extended = F.floor(FEW_TOKENS * F.pow(F.lit(2.0), rank - 1) / EXTEND_BY) - 1
    return F.when(rank == 0, CELLS).otherwise(F.greatest(F.lit(CELLS), extended)).cast("bigint")


def _signatures(shared: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(first, second, rank, digest, n, family): single rare tokens, and combinations of
    two frequent tokens of one cell; sets so small that a cell may stay alone go by single
    tokens too. Cells are those of the smaller set of a pair, so a set has combinations for
    its own class of sizes and for that of the smallest it can link to; as cells grow with
    the extension, combinations grow in proportion to tokens."""
    groups = (
        shared.select("token", "root")
        .distinct()
        .groupBy("token")
        .agg((F.count(F.lit(1)) > frequent).alias("often"))
    )
    classed = written(shared.join(groups, "token"), "classed")
    # Sets too small for their extended prefix, and those that these can link to.
    small = 100 * (100 * CELLS // percent) // percent
    single = classed.where(~F.col("often") | (F.col("n") <= small)).select(
        F.col("token").alias("first"),
        F.lit(0).cast("bigint").alias("second"),
        F.lit(0).alias("rank"),
        "digest",
        "n",
        "family",
    )
    smallest = F.ceil(F.col("n") * percent / 100)
    often = (
        classed.where("often")
        .withColumn("rank", F.explode(F.sequence(_rank(smallest), _rank(F.col("n")))))
        .withColumn("cell", F.pmod("token", _cells(F.col("rank"))))
    )
    other = often.select("digest", "rank", "cell", F.col("token").alias("second"))
    double = (
        often.join(other, ["digest", "rank", "cell"])
        .where(F.col("token") < F.col("second"))
        .select(F.col("token").alias("first"), "second", "rank", "digest", "n", "family")
    )
    return single.unionByName(double)


def _pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different families that share a signature, unless too few
    for a link. Families meet first, so that sets of one family never do."""
    signature = ["first", "second", "rank"]
    held = rows.select(*signature, "family").distinct()
    other = held.withColumnRenamed("family", "other")
    met = held.join(other, signature).where(F.col("family") < F.col("other"))
    left = rows.withColumnsRenamed({"digest": "a"})
    right = rows.withColumnsRenamed({"digest": "b", "n": "m", "family": "other"})
    lone = F.col("second") == 0
    rank = _rank(F.least("n", "m"))
    pairs = (
        met.join(left, [*signature, "family"])
        .join(right, [*signature, "other"])
        .where(_near(F.col("n"), F.col("m"), percent) & (lone | (F.col("rank") == rank)))
        .groupBy("a", "b", "n", "m")
        .agg(F.count_if(lone).alias("singles"), F.count_if(~lone).alias("doubles"))
    )
    # So many shared tokens of one cell make at least one combination less.
    most = F.col("singles") + F.col("doubles") + _cells(rank)
    least = F.least(_least_shared("n", percent), _least_shared("m", percent))
    return pairs.where(most >= least).select("a", "b")


def _pairs_within(held: DataFrame) -> DataFrame:
    """(low, high): every pair of blocks of one family that has several groups."""
    several = (
        held.groupBy("family")
        .agg(F.min("root").alias("least"), F.max("root").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("family")
    )
    low = held.select("family", F.col("block").alias("low")).distinct()
    high = low.withColumnRenamed("low", "high")
    met = low.join(several, "family").join(high, "family")
    return met.where(F.col("low") <= F.col("high")).select("low", "high")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the
    right, as products of 0/1 matrices over the tokens that both sides have."""
    sizes = [[len(s) for s in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    found = np.zeros((len(left), len(right)), np.float64)
    if not len(both):
        return found
    entries = []
    for tokens, lengths in zip(flat, sizes):
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.searchsorted(both, tokens)
        place[place == len(both)] = 0
        hit = both[place] == tokens
        order = np.argsort(place[hit], kind="stable")
        entries.append((row[hit][order], place[hit][order]))
    for start in range(0, len(both), COLUMNS):
        part = []
        for (row, place), lengths in zip(entries, sizes):
            low, high = np.searchsorted(place, [start, start + COLUMNS])
            matrix = np.zeros((len(lengths), min(COLUMNS, len(both) - start)), np.float32)
            matrix[row[low:high], place[low:high] - start] = 1
            part.append(matrix)
        found += part[0] @ part[1].T
    return found


def links_between(low: pd.DataFrame, high: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between different groups of two tables (digest, root, tokens), as many
    as hold together what they hold together; strips of ``low`` are judged in turn, so
    that memory grows with the sets of ``high`` alone."""
    sides = [low, high]
    tokens = [[np.asarray(t) for t in side["tokens"]] for side in sides]
    digests = [[bytes(d) for d in side["digest"]] for side in sides]
    names = {bytes(r): i for i, r in enumerate(pd.concat([s["root"] for s in sides]).drop_duplicates())}
    roots = [np.array([names[bytes(r)] for r in side["root"]]) for side in sides]
    sizes = [np.array([len(t) for t in side], float) for side in tokens]
    group = list(range(len(names)))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    links = []
    for start in range(0, len(low), STRIP):
        strip = slice(start, start + STRIP)
        both = overlaps(tokens[0][strip], tokens[1])
        # Of n and m tokens, k shared: 100 k >= percent (n + m - k).
        both *= 100 + percent
        least = percent * (sizes[0][strip, None] + sizes[1][None, :])
        linked = (both >= least) & (roots[0][strip, None] != roots[1][None, :])
        for i, j in np.argwhere(linked):
            a, b = find(roots[0][start + i]), find(roots[1][j])
            if a != b:
                group[a] = b
                links.append((digests[0][start + i], digests[1][j]))
    return pd.DataFrame(links, columns=["a", "b"])


def _links_within(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links between different groups of the sets (digest, root, tokens) of each family,
    as many as hold together what they hold together."""
    held = sets.select("digest", "root", "tokens").join(_small(blocks, KEYS), "digest")
    held = written(held, "block-sets")
    pairs = written(_pairs_within(held), "block-pairs")
    own = held.select(
        F.col("block").alias("low"), F.lit(False).alias("other"), "digest", "root", "tokens"
    )
    other = held.select(
        F.col("block").alias("high"), F.lit(True).alias("other"), "digest", "root", "tokens"
    )
    loaded = pairs.join(own, "low").unionByName(
        pairs.where("low != high").join(other, "high")
    )

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[~part["other"]], part[part["other"]]]
        if not len(sides[1]):
            sides[1] = sides[0]
        links = links_between(*sides, percent)
        release()
        return links

    return loaded.groupBy("low", "high").applyInPandas(judge, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    width: int = WIDTH,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, place, n_shingles, component_id, component) of every row of ``docs``.

    Rows link when the intersection of their shingle sets is at least ``percent`` per
    cent of the union; ``component_id`` is the least id reachable over links, the row's
    own included. ``place`` is a hash of the text, with which repeated ids can be told
    apart. ``component`` is a key of the
    component. Texts without words, empty or null, link with nothing and have no key. A
    null id is
    reachable like any other but is no component's id unless all of its ids are null.
    Other columns are not looked at; an empty table gives no row.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, doc_id, text, percent, width, frequent)


def _near_duplicates(
    docs: DataFrame, doc_id: str, text: str, percent: int, width: int, frequent: int
) -> DataFrame:
    source = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("place"),
        F.col(text).cast("string").alias("text"),
    )
    found = written(_sets(source, percent, width, whole=False), "sets")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    kinds = written(
        found.where("n > 0")
        .groupBy("digest", "n")
        .agg(F.min(first).alias("first"))
        .select("digest", "n", "first.id", "first.place"),
        "kinds",
    )
    prefixes = _shared_tokens(found.where("n > 0"), percent)
    needed = _small(
        written(
            kinds.join(prefixes.select("digest"), "digest").select(
                F.col("id").alias("need"), F.col("place").alias("at")
            ),
            "members",
        )
    )
    texts = source.join(
        needed, F.col("id").eqNullSafe(F.col("need")) & (F.col("place") == F.col("at"))
    ).select("id", "place", "text")
    # A row that is repeated brings its set again, until most sets are gone.
    sets = written(_sets(texts, percent, width, whole=True), "whole-sets").select(
        "digest", "n", "tokens"
    )
    enough = _with_enough(sets, _several(sets), _overlap(percent))
    sets = written(enough.dropDuplicates(["digest"]), "whole-sets")
    shared = written(
        prefixes.join(_small(sets.select("digest"), KEYS), "digest").select(
            "digest", "n", F.explode("tokens").alias("token")
        ),
        "shared",
    )

    # Each set against one of its buckets; then what may still link across the groups.
    rows = _across_groups(shared.withColumn("root", F.col("digest")))
    star = written(_star_pairs(rows, percent, 0), "star-pairs")
    named = written(_families(sets.select("digest", "n"), star), "families")
    links = written(
        verified(star, sets, written(_blocks(named), "blocks"), percent), "star-links"
    )
    grouped = written(_rooted(named, components(links)), "grouped").drop("n")
    held = sets.join(_small(grouped, KEYS), "digest")
    held = written(_linkable(held, "root", percent), "linkable")
    blocks = written(_blocks(held.select("digest", "n", "family")), "blocks")
    within = written(_links_within(held, blocks, percent), "family-links")

    # Across families, of sets with enough in other families.
    for _ in range(2):
        held = written(_linkable(held, "family", percent), "linkable")
    rows = shared.join(held.select("digest", "root", "family"), "digest")
    rows = written(_across_groups(rows, "family"), "across")
    signatures = written(_signatures(rows, percent, frequent), "signatures")
    pairs = written(_pairs_across(signatures, percent), "across-pairs")
    fresh = written(verified(pairs, held, blocks, percent), "across-links")
    links = links.unionByName(within).unionByName(fresh)
    roots = components(links)

    labelled = kinds.select("digest", "id").join(
        roots.withColumnRenamed("node", "digest"), "digest", "left"
    ).withColumn("root", F.coalesce("root", "digest"))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    of_kind = labelled.join(least, "root").select(
        "digest", "component_id", F.col("root").alias("component")
    )
    return found.select("id", "place", "n", "digest").join(of_kind, "digest", "left").select(
        F.col("id").alias("doc_id"),
        "place",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        "component",
    )


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that stay when of each component one row does: that of the
    least id, of rows that share it the one of the least text hash and then of the
    least hash of all columns. Rows whose text has no words all stay. Columns are kept
    whatever their names; a null id comes last."""
    found = near_duplicates(docs, doc_id, text, **options)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    winners = (
        found.where("component is not null")
        .groupBy("component")
        .agg(F.min(place).alias("first"))
        .select(F.col("first.doc_id").alias("_id"), F.col("first.place").alias("_at"))
    )
    words = F.rlike(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD))
    rows = docs.where(words).select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
        F.col(doc_id).alias("_own"),
        F.xxhash64(F.col(text).cast("string")).alias("_place"),
    )
    met = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_place") == F.col("_at"))
    among = Window.partitionBy("_id", "_at").orderBy(F.xxhash64("_row"))
    stay = (
        rows.join(winners, met)
        .withColumn("_nth", F.row_number().over(among))
        .where("_nth = 1")
    )
    return stay.select("_row.*").unionByName(docs.where(~words))


def _with_enough(
    rows: DataFrame,
    tokens: DataFrame,
    least: Callable[[np.ndarray], np.ndarray],
    trim: bool = False,
) -> DataFrame:
    """The rows (n, tokens, ...) with at least ``least(n)`` of their tokens among those of
    ``tokens``, by a bounded filter in each task that lets some more through and loses
    none. If ``trim``, other tokens go."""
    shared = KeyFilter(tokens.select(F.col("token").alias("key")), FILTER_BLOCKS).table
    names = rows.columns
    size, place = names.index("n"), names.index("tokens")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(place)
                lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                hit = known(table, flat)
                ends = np.cumsum(lengths, dtype=np.int64)
                before = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                found = before[ends] - before[ends - lengths]
                enough = found >= least(batch.column(size).to_numpy())
                columns = list(batch.columns)
                if trim:
                    offsets = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
                    columns[place] = pa.ListArray.from_arrays(offsets, flat[hit])
                kept = pa.RecordBatch.from_arrays(columns, names=names)
                yield kept.filter(pa.array(enough))
        release()

    return rows.mapInArrow(choose, rows.schema)


def _several(rows: DataFrame) -> DataFrame:
    """Tokens of more than one of the rows (tokens)."""
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("kinds")
    )
    return written(counts.where("kinds > 1").select("token"), "several")


def _shared_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(digest, n, tokens): the kinds of sets that share as many prefix tokens with others
    as a link asks for, and those tokens. Most sets go before equal ones are made one, so
    that few prefixes are shuffled."""

    def least(n: np.ndarray) -> np.ndarray:
        return np.minimum((percent * n + 99) // 100, np.maximum(1 + CELLS, n // EXTEND_BY))

    def passed(rows: DataFrame) -> DataFrame:
        return _with_enough(rows, _several(rows), least, trim=True)

    kinds = passed(sets.select("digest", "n", "tokens")).dropDuplicates(["digest"])
    rows = written(kinds, "shared-kinds")
    for _ in range(2):
        rows = written(passed(rows), "shared")
    return rows


def _overlap(percent: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda n: (percent * n + 99) // 100


def _linkable(sets: DataFrame, group: str, percent: int) -> DataFrame:
    """The sets (n, tokens, ...) of which as much is in sets of other groups as a link to
    one of these asks for. Groups are told apart by 64-bit hashes."""
    tokens = sets.select(F.explode("tokens").alias("token"), F.xxhash64(group).alias("group"))
    mixed = (
        tokens.groupBy("token")
        .agg(F.min("group").alias("low"), F.max("group").alias("high"))
        .where("low != high")
        .select("token")
    )
    return _with_enough(sets, written(mixed, "mixed"), _overlap(percent))


def _rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.withColumnRenamed("node", "digest")
    return sets.join(named, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
