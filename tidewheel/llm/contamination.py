"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set and is worked off in blocks of bounded size; each block
is held against all documents. A pass over the documents finds every n-gram of the
block's items and keeps the stretch of words around it. The documents that hold each
n-gram are counted; an item's seeds are its rare n-grams and, in every few places, its
rarest one that occurs at all, so an item that leaked often keeps seeds. Stretches with
a seed of an item are aligned with it, word by word, which scores edited and
paraphrased copies too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import utf8_column, written

GRAM = 4
# An n-gram is rare in up to this share of the documents, or this many of them.
RARE_SHARE = 0.001
RARE_LEAST = 20
STRIDE = 4
# Shorter items cannot be told from chance and are not searched for.
LEAST_WORDS = 8
# A stretch of this many words counts in full, however long the item.
FULL_WORDS = 40
LEAST_SCORE = 0.5
# Words of the items that one pass over the documents searches for.
BLOCK_WORDS = 2_000_000
MATCH, OTHER, GAP = 2, -1, -1
EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
RESULT = (
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()),
    T.StructField("seeds", T.IntegerType()),
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word without case and outer punctuation."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
        bare = word.decode("utf-8", "replace").casefold().strip(EDGE)
        found = self[word] = xxhash.xxh64_intdigest(bare.encode("utf-8", "replace"))
        return found

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    many = len(words) - n + 1
    mixed = np.zeros(many, np.uint64)
    for i in range(n):
        mixed = (mixed ^ words[i : i + many]) * _FACTOR
        mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: words, ids of the items with these words, and the
    sorted n-grams with the items and places of each."""

    words: list[np.ndarray]
    ids: list[list]
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(rows: Sequence, n: int, least_words: int) -> Items:
        cache, seen = WordHashes(), {}
        for item_id, text in rows:
            words = cache.of((text or "").encode())
            if len(words) >= max(least_words, n):
                seen.setdefault(words.tobytes(), []).append(item_id)
        words = [np.frombuffer(key, np.uint64) for key in seen]
        found = [grams(w, n) for w in words]
        sizes = [len(g) for g in found]
        gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(words)), sizes)
        place = np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, int)])
        order = np.argsort(gram, kind="stable")
        return Items(words, list(seen.values()), gram[order], item[order], place[order])

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, and the words of the longest item that has each."""
        known, first = np.unique(self.gram, return_index=True)
        lengths = np.array([len(w) for w in self.words], np.int64)[self.item]
        return known, np.maximum.reduceat(lengths, first) if len(known) else lengths

    def seeds(self, counts: dict[int, int], rare: float, stride: int) -> Items:
        """Only the rare n-grams that occur, and the rarest of every ``stride`` places
        of an item."""
        n = np.fromiter((counts.get(g, 0) for g in self.gram.tolist()), np.int64)
        keep = (n > 0) & (n <= rare)
        there = np.flatnonzero(n > 0)
        order = there[
            np.lexsort((n[there], self.place[there] // stride, self.item[there]))
        ]
        cell = np.stack([self.item[order], self.place[order] // stride])
        first = np.ones(len(order), bool)
        first[1:] = (cell[:, 1:] != cell[:, :-1]).any(axis=0)
        keep[order[first]] = True
        return Items(
            self.words, self.ids, self.gram[keep], self.item[keep], self.place[keep]
        )


def _best(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score and where, in text and item, the best alignment ends."""
    at = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item, 1):
        step = np.where(text == word, MATCH, OTHER)
        fresh = np.maximum(row + GAP, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + step)
        # A gap in the item costs by its length: the best start of it so far.
        row = np.maximum.accumulate(fresh + at) - at
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), j, i)
    return best


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Score, start and end in ``text`` of the best local alignment with ``item``."""
    score, stop, until = _best(text, item)
    if not score:
        return 0, 0, 0
    _, back, _ = _best(text[:stop][::-1], item[:until][::-1])
    return score, stop - back, stop


def _stretches(
    docs: DataFrame, keys: Sequence[str], text: str, items: Items, n: int
) -> DataFrame:
    """Words around every n-gram of the items: keys, start, words, n-grams, and those
    that the document shows here first."""
    known, reach = items.reach()
    maybe = np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(44)).astype(np.int64)] = True
    schema = T.StructType(
        [docs.schema[k] for k in keys]
        + [
            T.StructField("_start", T.IntegerType()),
            T.StructField("_words", T.ArrayType(T.LongType())),
            T.StructField("_grams", T.ArrayType(T.LongType())),
            T.StructField("_fresh", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows, found = [], ([], [], [], [])
            for i, doc in enumerate(utf8_column(batch, "_text")):
                words = cache.of(doc)
                own = grams(words, n)
                at = np.flatnonzero(maybe[(own >> np.uint64(44)).astype(np.int64)])
                place = np.searchsorted(known, own[at])
                place[place == len(known)] = 0
                hit = known[place] == own[at]
                at, place = at[hit], place[hit]
                if not len(at):
                    continue
                seen: set[int] = set()
                low = np.maximum(at - reach[place], 0)
                high = np.minimum(at + n + reach[place], len(words))
                upto = np.maximum.accumulate(high)
                cuts = np.flatnonzero(low[1:] > upto[:-1]) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    start, stop = int(low[part].min()), int(high[part].max())
                    grams_here = own[at[part]].view(np.int64)
                    distinct = set(grams_here.tolist())
                    rows.append(i)
                    found[0].append(start)
                    found[1].append(words[start:stop].view(np.int64))
                    found[2].append(grams_here)
                    found[3].append(list(distinct - seen))
                    seen |= distinct
            take = pa.array(rows, pa.int64())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(len(keys))]
                + [pa.array(found[0], pa.int32())]
                + [pa.array(values, longs) for values in found[1:]],
                names=schema.fieldNames(),
            )

    source = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    gram: int = GRAM,
    least_score: float = LEAST_SCORE,
    full_words: int = FULL_WORDS,
    least_words: int = LEAST_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(keys, item_id, score, start, stop, seeds): the best alignment of each document
    with each item that scores at least ``least_score``.

    The score is the alignment's over that of a full match of the item, or of
    ``full_words`` of its words, at most 1. ``start`` and ``stop`` count words of the
    document. Words are compared without case and outer punctuation. Items of equal
    words all get the result; items of fewer than ``least_words`` words, or null, get
    none, as do null and empty documents. Rows equal in ``keys`` count as one document
    whose best stretch is told. Other columns are not looked at; an empty table on
    either side gives no row.
    """
    sizes = items.select(
        F.size(F.split(F.trim(F.coalesce(item_text, F.lit(""))), r"[\x20\x09-\x0D]+")).alias("n")
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    rare = max(RARE_LEAST, RARE_SHARE * docs.count()) if blocks else 0
    parts = []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64(item_text), F.lit(blocks)) == block
        # About ``block_words`` words: a bounded part of the query set.
        rows = items.where(mine).select(item_id, item_text).collect()
        own = Items.of(rows, gram, least_words)
        if not own.words:
            continue
        found = written(_stretches(docs, keys, text, own, gram), "stretches")
        counts = (
            found.select(F.explode("_fresh").alias("gram"))
            .groupBy("gram")
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        seen = {int(np.int64(r["gram"]).view(np.uint64)): r["n"] for r in counts}
        seeds = own.seeds(seen, rare, STRIDE)
        parts.append(
            _aligned(found, keys, seeds, items.schema[item_id], least_score, full_words)
        )
    if not parts:
        fields = [docs.schema[k] for k in keys] + [items.schema[item_id], *RESULT]
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    best = F.max(
        F.struct("score", (-F.col("start")).alias("first"), "stop", "seeds")
    ).alias("best")
    return hits.groupBy(*keys, item_id).agg(best).select(
        *keys,
        item_id,
        "best.score",
        (-F.col("best.first")).alias("start"),
        "best.stop",
        "best.seeds",
    )


def _aligned(
    found: DataFrame,
    keys: Sequence[str],
    seeds: Items,
    item_field: T.StructField,
    least_score: float,
    full_words: int,
) -> DataFrame:
    schema = T.StructType(
        [found.schema[k] for k in keys]
        + [item_field, *RESULT]
    )
    item_kind = T.StructType([item_field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(item_kind).field(0).type
        memory: dict[tuple, tuple[int, int, int]] = {}
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            n = len(keys)
            starts = batch.column(n).to_pylist()
            for i, start in enumerate(starts):
                own = np.array(batch.column(n + 2)[i].as_py(), np.int64).view(np.uint64)
                own = own[np.isin(own, seeds.gram)]
                if not len(own):
                    continue
                low = np.searchsorted(seeds.gram, own, "left")
                high = np.searchsorted(seeds.gram, own, "right")
                items = np.concatenate(
                    [seeds.item[a:b] for a, b in zip(low.tolist(), high.tolist())]
                )
                words = np.array(batch.column(n + 1)[i].as_py(), np.int64).view(np.uint64)
                key = words.tobytes()
                for item, many in zip(*(x.tolist() for x in np.unique(items, return_counts=True))):
                    if (key, item) not in memory:
                        if len(memory) > 20_000:
                            memory.clear()
                        memory[key, item] = align(words, seeds.words[item])
                    score, first, stop = memory[key, item]
                    whole = MATCH * min(len(seeds.words[item]), full_words)
                    share = min(1.0, score / whole)
                    if share < least_score:
                        continue
                    for one in seeds.ids[item]:
                        rows.append(i)
                        for values, v in zip(out, (one, share, start + first, start + stop, many)):
                            values.append(v)
            take = pa.array(rows, pa.int64())
            kinds = [kind, pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(n)]
                + [pa.array(values, t) for values, t in zip(out, kinds)],
                names=schema.fieldNames(),
            )

    return found.drop("_fresh").mapInArrow(run, schema)
