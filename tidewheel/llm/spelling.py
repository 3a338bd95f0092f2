"""Spelling variants: words one code point apart, grouped below their frequent forms.

The vocabulary is cut into shards by length, each with a blocked Bloom filter. Filters
are broadcast, at most ``FILTER_BYTES`` of them at a time, and every word probes them
with its generated edits. Only positives shuffle, to an exact join with the vocabulary,
which removes the false ones.

Deletions are generated from the longer word of a pair and replacements from the word
with the smaller letter, so a pair comes up once, and insertions need no probes.

Defined results: a null text has no words, a null id counts as an empty one, rows that
repeat count each time, ties between forms go to the smallest word in code-point order,
an empty table has no words. Columns of the documents beside id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import utf8_column, written

# Words have letters A-Z, a-z and U+00C0 to U+00FF: in UTF-8 the ASCII letters and C3
# followed by any continuation byte. All other sequences separate.
OTHERS = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 0x80 <= c <= 0xBF or c == 0xC3 else 32
    for c in range(256)
)
# A run is damaged if this divides its hash, which stands for misspelt words.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
# A form is at least so many times as frequent.
RATIO = 2
# Distinct words counted in memory before they are handed on.
COUNTED = 400_000

# Lengths from this on share shards; the join tells them apart.
LONGEST_CLASS = 64
# Words of a part of a shard, and 64-bit blocks of its filter per 8 words: 24 bits a word.
SHARD_WORDS, BLOCKS_PER_8 = 1 << 16, 3
# Bytes of filters broadcast in one pass; a larger vocabulary takes several passes.
FILTER_BYTES = 1 << 26
# Words of a probing task, and probes held at a time.
TASK_WORDS, PROBES = 50_000, 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of every distinct word of at least ``LEAST_LENGTH`` letters, damage done."""
    chosen = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    counted = chosen.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for name, text in zip(utf8_column(batch, "id"), utf8_column(batch, "text")):
            if not text.isascii():
                text = OTHERS.sub(b" ", text)
            words = text.translate(LETTERS).split()
            if not words:
                continue
            counts.update(words)
            for word, n in _damaged(name, words):
                counts[word] -= n
                counts[_without_one(name, word)] += n
            if len(counts) > COUNTED:
                yield _batch(counts)
                counts = Counter()
    yield _batch(counts)


def _damaged(name: bytes, words: list[bytes]) -> Iterable[tuple[bytes, int]]:
    """Words of a document to be damaged, with their counts."""
    distinct = list(set(words))
    hashes = np.fromiter(
        map(crc32, distinct, repeat(crc32(name + b":"))), np.uint32, len(distinct)
    )
    hit = {distinct[i] for i in np.flatnonzero(hashes % DAMAGE == 0)}
    return Counter(filter(hit.__contains__, words)).items() if hit else ()


def _without_one(name: bytes, word: bytes) -> bytes:
    letters = word.decode()
    at = crc32(name + b":" + word) % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _batch(counts: Counter) -> pa.RecordBatch:
    kept = [
        (word, n)
        for word, n in counts.items()
        if n and (len(word) >= LEAST_LENGTH if word.isascii() else len(word.decode()) >= LEAST_LENGTH)
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()),
            pa.array([n for _, n in kept], pa.int64()),
        ],
        ["word", "n"],
    )


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return hashes ^ (hashes >> np.uint64(33))


def _letter_values(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes.astype(np.uint64) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def _hashes(codes: np.ndarray) -> np.ndarray:
    powers = _powers(codes.shape[1])[: codes.shape[1]]
    return (_letter_values(codes) * powers).sum(axis=1, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    by: dict[int, list[str]] = {}
    for word in words:
        by.setdefault(len(word), []).append(word)
    yield from by.items()


def _bits(keys: np.ndarray) -> np.ndarray:
    """Four bits of a block, from the key's low half."""
    found = np.zeros(len(keys), np.uint64)
    for shift in (0, 6, 12, 18):
        found |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
    return found


def _place(keys: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """A number below n from the key's high half."""
    return ((keys >> np.uint64(32)) * np.asarray(n, np.uint64)) >> np.uint64(32)


def _key(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys within a filter, and the parts they are in."""
    keys = _mixed(hashes)
    return keys, _place(_mixed(keys), parts).astype(np.int64)


class Filters:
    """The filters of a length's parts, as far as this pass has them, end to end."""

    def __init__(self, bits: dict[int, bytes], parts: int):
        self.parts = parts
        self.blocks = np.zeros(parts, np.uint64)
        self.start = np.zeros(parts, np.int64)
        tables, filled = [], 0
        for part, table in bits.items():
            tables.append(np.frombuffer(table, np.uint64))
            self.blocks[part], self.start[part] = len(tables[-1]), filled
            filled += len(tables[-1])
        self.table = np.concatenate(tables)

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        keys, part = _key(hashes, self.parts)
        blocks = self.blocks[part]
        at = self.start[part] + _place(keys, blocks).astype(np.int64)
        bits = _bits(keys)
        return (blocks > 0) & ((self.table[at] & bits) == bits)


def _dealing(parts: dict[int, int]) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in _by_length(batch.column(0).to_pylist()):
                own = parts[min(length, LONGEST_CLASS)]
                keys, part = _key(_hashes(_codes(words, length)), own)
                letters = "".join(sorted(set("".join(words))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(words), min(length, LONGEST_CLASS), np.int32)),
                        pa.array(part.astype(np.int32)),
                        pa.array(keys.view(np.int64)),
                        pa.array([letters] + [""] * (len(words) - 1), pa.string()),
                    ],
                    ["class", "part", "key", "letters"],
                )

    return deal


def _built(shard: pd.DataFrame) -> pd.DataFrame:
    keys = shard["key"].to_numpy(np.int64).view(np.uint64)
    blocks = len(keys) * BLOCKS_PER_8 // 8 + 1
    table = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(table, _place(keys, blocks).astype(np.int64), _bits(keys))
    letters = "".join(sorted(set("".join(shard["letters"]))))
    row = (shard["class"].iloc[0], shard["part"].iloc[0], letters, table.tobytes())
    return pd.DataFrame([row], columns=["class", "part", "letters", "bits"])


def shard_counts(vocabulary: DataFrame) -> dict[int, int]:
    """Parts of each length's shard, of about ``SHARD_WORDS`` words by a hash."""
    length = F.least(F.length("word"), F.lit(LONGEST_CLASS)).alias("class")
    counts = vocabulary.groupBy(length).count().collect()
    return {row["class"]: -(-row["count"] // SHARD_WORDS) for row in counts}


def bloom_shards(vocabulary: DataFrame, parts: dict[int, int]) -> DataFrame:
    """(class, part, letters, bits): a filter for each part of a length's shard, and the
    letters met while dealing its words out."""
    dealt = vocabulary.select("word").mapInArrow(
        _dealing(parts), "class int, part int, key bigint, letters string"
    )
    return dealt.groupBy("class", "part").applyInPandas(
        _built, "class int, part int, letters string, bits binary"
    )


def _passes(shards: DataFrame, limit: int) -> Iterator[list]:
    """Filters in groups of at most ``limit`` bytes, or one. The sizes are listed first:
    a row stands for about ``SHARD_WORDS`` words."""
    sizes = shards.select("class", "part", F.octet_length("bits").alias("size")).orderBy(
        "class", "part"
    )
    group, total = [], 0
    for row in sizes.collect():
        if group and total + row["size"] > limit:
            yield group
            group, total = [], 0
        group.append((row["class"], row["part"]))
        total += row["size"]
    if group:
        yield group


def near_pairs(vocabulary: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(a, a_n, b, b_n) of words of ``vocabulary`` (word, n) exactly one code point apart,
    each pair once."""
    spark = vocabulary.sparkSession
    tasks = max(vocabulary.count() // TASK_WORDS, 1)
    words = vocabulary.repartition(tasks, "word")
    parts = shard_counts(vocabulary)
    shards = written(bloom_shards(vocabulary, parts), "spelling-filters")
    letters = shards.select("class", F.explode(F.split("letters", "")).alias("letter"))
    alphabet = {
        row["class"]: row["letters"]
        for row in letters.where("letter <> ''")
        .groupBy("class")
        .agg(F.array_join(F.sort_array(F.collect_set("letter")), "").alias("letters"))
        .collect()
    }
    positives = None
    for group in _passes(shards, limit):
        chosen = shards.where(
            F.struct("class", "part").isin([F.struct(F.lit(c), F.lit(p)) for c, p in group])
        )
        filters: dict[int, dict[int, bytes]] = {}
        for row in chosen.select("class", "part", "bits").collect():
            filters.setdefault(row["class"], {})[row["part"]] = bytes(row["bits"])
        shared = spark.sparkContext.broadcast((filters, alphabet, parts))
        found = words.mapInArrow(_probing(shared), "word string, n bigint, edit string")
        positives = found if positives is None else positives.union(found)
    if positives is None:
        return vocabulary.limit(0).selectExpr("word a", "n a_n", "word b", "n b_n")
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("b_n"))
    return positives.join(known, "edit").selectExpr("word a", "n a_n", "edit b", "b_n")


def _probing(shared) -> Callable:
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, alphabet, parts = shared.value
        tables = {c: Filters(bits, parts[c]) for c, bits in filters.items()}
        for batch in batches:
            counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, words in _by_length(list(counts)):
                room = max(PROBES // (length * 90), 1)
                for i in range(0, len(words), room):
                    some = words[i : i + room]
                    for at, edits in _edits(some, length, tables, alphabet):
                        own = [some[k] for k in at]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(own, pa.string()),
                                pa.array([counts[w] for w in own], pa.int64()),
                                pa.array(edits, pa.string()),
                            ],
                            ["word", "n", "edit"],
                        )

    return probe


def _edits(
    words: list[str], length: int, tables: dict, alphabet: dict
) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of words, and their edits that some filter lets through."""
    codes = _codes(words, length)
    powers = _powers(length)
    terms = _letter_values(codes) * powers[:length]
    whole = terms.sum(axis=1, dtype=np.uint64)
    shorter = tables.get(min(length - 1, LONGEST_CLASS))
    if shorter and length > LEAST_LENGTH:
        # What stands behind the lost letter moves one place to the front.
        ahead = np.cumsum(terms, axis=1, dtype=np.uint64)
        left = (ahead - terms) + (whole[:, None] - ahead) * INVERSE
        # Of equal letters in a row the first is deleted.
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        rows, at = np.nonzero(fresh)
        hit = shorter.hold(left[rows, at])
        if hit.any():
            rows, at = rows[hit], at[hit]
            yield rows, [words[r][:i] + words[r][i + 1 :] for r, i in zip(rows, at)]
    same = tables.get(min(length, LONGEST_CLASS))
    letters = alphabet.get(min(length, LONGEST_CLASS), "") if same else ""
    for letter in letters:
        code = np.uint32(ord(letter))
        rows, at = np.nonzero(codes < code)
        new = _letter_values(np.array([code]))[0] * powers[at]
        hit = same.hold(whole[rows] - terms[rows, at] + new)
        if hit.any():
            rows, at = rows[hit], at[hit]
            yield rows, [words[r][:i] + letter + words[r][i + 1 :] for r, i in zip(rows, at)]


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = FILTER_BYTES
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with ``LEAST_COUNT`` uses.

    A form is the near word of largest n, smallest in code-point order among equals, if it
    has at least ``RATIO`` times the word's n. Counts at least double from a word to its
    form, so chains are as short as the logarithm of the largest count, and pointers
    double along them: the rounds are the logarithm of that."""
    counts = word_counts(docs, id_col, text).where(F.col("n") >= LEAST_COUNT)
    vocabulary = written(counts, "spelling-words")
    pairs = written(near_pairs(vocabulary, limit), "spelling-pairs")
    both = pairs.selectExpr("a word", "b near", "b_n near_n").unionAll(
        pairs.selectExpr("b word", "a near", "a_n near_n")
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"),
    )
    enough = -F.col("best.rank") >= RATIO * F.col("n")
    formed = written(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.rank")).alias("form_n"),
        ),
        "spelling-forms",
    )
    steps = formed.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        ahead = steps.selectExpr("word `to`", "`to` beyond")
        further = written(
            steps.join(ahead, "to", "left").select(
                "word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        steps = further.select("word", "to")
        if further.where("moved").isEmpty():
            break
    roots = steps.withColumnRenamed("to", "root")
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
