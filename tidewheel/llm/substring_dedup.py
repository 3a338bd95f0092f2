"""Substring dedup: a compressed FM-index per shard, searched backwards.

Every stretch of ``span`` words (a window) that was there before is removed. Windows are
dealt to shards by the least hash of the short n-grams they hold: equal windows have the
same one, and windows that follow each other mostly share it, so a document falls into
runs of windows that go to one shard as one stretch of words. A stretch whose least hash
no other stretch has holds no window that occurs elsewhere; equal stretches are one,
from their first place on. The rest is indexed.

A shard is the words of its stretches, in order of document and place, behind each
other. Its FM-index is the Burrows-Wheeler transform in a wavelet matrix, a bit vector
per bit of the word numbers with counts per 64 bits. All windows of the shard are
searched at once, from their last word backwards; those whose interval holds a single
suffix occur once and are done, which gives the matching statistics up to the span.
What is left is a repeat, and its interval's first suffix is the one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import lean, written
from tidewheel.llm.pruning import KeyFilter
from tidewheel.llm.words import joined, word_ranges

SPAN = 20
GRAM = 6
SHARD_WORDS = 300_000
# Bits of a word's number that a level of the wavelet matrix tells apart.
DIGIT = 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _run_hash(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    many = len(words) - size + 1
    mixed = np.full(many, seed, np.uint64)
    for i in range(size):
        mixed = (mixed ^ words[i : i + many]) * _FACTOR
        mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(words: np.ndarray, span: int, gram: int, texts: np.ndarray | None = None):
    """Runs of windows with one least n-gram: its hash, first word, windows, and
    whether the run has it more than once, as one with a repeat inside must. The words
    are those of texts of ``span`` words or more, of which each has its own runs."""
    texts = np.array([len(words)]) if texts is None else texts
    grams = _run_hash(words, gram)
    least = _sliding_min(grams, span - gram + 1)
    ends = np.cumsum(texts)
    opens = np.append(True, least[1:] != least[:-1])
    opens[ends[:-1]] = True
    # Windows that reach into the next text are none.
    across = (ends[:-1, None] - np.arange(1, span)).ravel()
    opens[across] = False
    starts = np.flatnonzero(opens)
    stops = np.append(starts[1:], len(words))
    stops[np.searchsorted(starts, ends) - 1] -= span - 1
    least, windows = least[starts], stops - starts
    sizes = windows + span - gram
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)
    same = grams[inside] == np.repeat(least, sizes)
    return least, starts, windows, np.add.reduceat(same.astype(np.int32), begins) > 1


class BitRank:
    """How many of the bits before each place are ones, as running counts."""

    def __init__(self, bits: np.ndarray):
        kind = np.int32 if len(bits) < 1 << 31 else np.int64
        self.before = np.zeros(len(bits) + 1, kind)
        np.cumsum(bits, out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        return self.before[at]


class WaveletMatrix:
    """How often a symbol occurs before a place, by a level per DIGIT bits of the symbols.
    Each level sorts them stably by their digit there and holds, for each digit and place,
    where the next symbol of that digit goes: one look-up a level and place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size = len(symbols) + 1
        self.levels: list[tuple[int, np.ndarray]] = []
        for level in reversed(range(0, bits, DIGIT)):
            digits = (symbols >> level) & ((1 << DIGIT) - 1)
            own = [digits == d for d in range(1 << DIGIT)]
            ranks = [BitRank(o) for o in own]
            begins = np.cumsum([0] + [r.ones for r in ranks[:-1]])
            goes = [r.before + r.before.dtype.type(b) for r, b in zip(ranks, begins)]
            self.levels.append((level, np.concatenate(goes)))
            symbols = np.concatenate([symbols[o] for o in own])

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place, on top of a start per symbol;
        ``at`` may have several rows of places."""
        for level, goes in self.levels:
            digit = (symbol >> level) & ((1 << DIGIT) - 1)
            at = goes[digit * self.size + at]
        return at

    def begin(self, symbol: np.ndarray) -> np.ndarray:
        return self.count(symbol, np.zeros(len(symbol), np.int64))


class FmIndex:
    """FM-index of texts of numbers from 1 on, each text ended by its own mark; for
    searches of up to ``depth`` words if that is given."""

    def __init__(self, text: np.ndarray, top: int, depth: int | None = None):
        """``text`` holds 0 where texts end; ``top`` is the largest number."""
        self.suffixes = _suffix_array(text, depth or len(text))
        last = text[self.suffixes - 1]  # wraps to the last mark for the first suffix
        bits = max(1, int(top).bit_length())
        self.wavelet = WaveletMatrix(last, bits)
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.begin = self.wavelet.begin(np.arange(top + 1))

    def search(self, text: np.ndarray, ends: np.ndarray, depth: int):
        """Backward search from each end (exclusive) for at most ``depth`` words.

        Gives the matching statistics, the longest match of at least two suffixes
        that ends there, and the interval of suffixes where it reached the depth."""
        matched = np.zeros(len(ends), np.int64)
        word = text[ends - 1]
        low, high = self.first[word], self.first[word + 1]
        active = np.flatnonzero(high - low > 1)
        low, high = low[active], high[active]
        matched[active] = 1
        for step in range(2, depth + 1):
            if not len(active):
                break
            # Before the first word of a text there is an end mark, or nothing.
            word = np.where(ends[active] >= step, text[ends[active] - step], 0)
            within = word > 0
            active, low, high, word = (x[within] for x in (active, low, high, word))
            base = self.first[word] - self.begin[word]
            low, high = base + self.wavelet.count(word, np.stack([low, high]))
            on = high - low > 1
            active, low, high = active[on], low[on], high[on]
            matched[active] = step
        return matched, active, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in the text among the suffixes of each interval."""
        if not len(low):
            return low
        pairs = low * (len(self.suffixes) + 1) + high
        _, first, back = np.unique(pairs, return_index=True, return_inverse=True)
        cuts = np.stack([low[first], high[first]], axis=1).ravel()
        padded = np.append(self.suffixes, np.iinfo(np.int64).max)
        # Every second of the reduced pieces is an interval, the others lie between.
        return np.minimum.reduceat(padded, cuts)[::2][back.ravel()]


def _suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by ``depth`` words at least, by doubling; end marks sort by place,
    before all words. What is equal that far stays in any order."""
    n = len(text)
    marks = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(marks)
    rank[marks] = np.arange(len(marks))
    width = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - width] = rank[width:]
        pair = rank * (n + len(marks) + int(text.max(initial=0)) + 2) + ahead + 1
        order, pair = _sorted(pair)
        places = np.cumsum(np.append(False, pair[1:] != pair[:-1]))
        width *= 2
        if width >= depth or n == 0 or places[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = places


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the numbers, from 0 on, in their order, and the numbers in it. Where
    a place fits into the number as well, plain numbers are sorted, which is faster."""
    bits = max(len(values) - 1, 1).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(values)
        return order, values[order]
    both = np.sort(values << bits | np.arange(len(values)))
    return both & ((1 << bits) - 1), both >> bits


def repeated_windows(words: list[np.ndarray], span: int = SPAN) -> list[np.ndarray]:
    """For each stretch, in order, which of its windows occur earlier in the shard."""
    sizes = np.array([len(w) for w in words], np.int64)
    earlier = _earlier(np.concatenate(words), sizes, span)
    return np.split(earlier, np.cumsum(sizes - span + 1)[:-1])


def _earlier(words: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Which windows of the stretches, ``sizes`` words each behind each other, occur
    earlier."""
    numbers = np.unique(words, return_inverse=True)[1].ravel() + 1
    text = np.zeros(len(words) + len(sizes), np.int64)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside] = numbers
    index = FmIndex(text, int(numbers.max()), span)
    begins = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - span + 1
    starts = np.repeat(begins - (np.cumsum(windows) - windows), windows)
    starts = starts + np.arange(int(windows.sum()))
    _, found, low, high = index.search(text, starts + span, span)
    earlier = np.zeros(len(starts), bool)
    earlier[found] = index.earliest(low, high) < starts[found]
    return earlier


def _spans(earlier: np.ndarray, windows: np.ndarray, span: int):
    """Runs of windows within one stretch, as word intervals of it: the stretch's number,
    first word and the one behind the last."""
    ends = np.cumsum(windows)
    begins = ends - windows
    opens, closes = earlier.copy(), earlier.copy()
    opens[1:] &= ~earlier[:-1]
    closes[:-1] &= ~earlier[1:]
    opens[begins], closes[ends - 1] = earlier[begins], earlier[ends - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(ends, opens, "right")
    return row, opens - begins[row], closes - begins[row] + span


def repeated_spans(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(id, tie, start, stop): the word intervals of documents (id, tie, text) that are
    covered by windows which occur earlier, by (id, tie) and place."""
    key = [docs.schema["id"], docs.schema["tie"]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, found in word_ranges(batch, "text"):
                sizes = found.counts
                long = sizes >= span
                if not long.any():
                    continue
                words = found.hashes()[np.repeat(long, sizes)]
                sizes = sizes[long]
                least, at, many, inner = stretches(words, span, gram, sizes)
                # Hash of a stretch: difference of running sums, kept apart by length.
                digest = _positional(words, at, at + many + span - 1)
                ends = np.cumsum(sizes)
                text = np.searchsorted(ends, at, "right")
                start = at - (ends - sizes)[text]
                take = pa.array((low + np.flatnonzero(long))[text])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(least.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(many.astype(np.int32)),
                        pa.array(inner),
                    ],
                    names=cut_schema.fieldNames(),
                )

    longs, ints = T.LongType(), T.IntegerType()
    cut_schema = T.StructType(
        [
            *key,
            T.StructField("least", longs),
            T.StructField("digest", longs),
            T.StructField("start", ints),
            T.StructField("windows", ints),
            T.StructField("inner", T.BooleanType()),
        ]
    )
    runs = written(
        docs.select("id", "tie", "text").mapInArrow(lean(cut), cut_schema), "stretches"
    )
    several = (
        runs.groupBy("least")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("inner").alias("inner"))
        .where("rows > 1 or inner")
        .select("least")
    )
    runs = written(runs.drop("inner").join(several, "least"), "shared-stretches")
    place = F.struct("id", "tie", "start")
    kinds = written(
        runs.groupBy("least", "digest", "windows")
        .agg(F.min(place).alias("first"))
        .select("least", "digest", "windows", "first"),
        "kinds",
    )
    copies = runs.join(kinds, ["least", "digest", "windows"]).where(
        place != F.col("first")
    )
    copied = copies.select(
        "id", "tie", "start", (F.col("start") + F.col("windows") + span - 1).alias("stop")
    )
    found = _indexed(docs, kinds, span, shard_words)
    return copied.unionByName(found)


def _positional(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words, the same wherever it stands."""
    power = np.cumprod(np.full(len(words), _FACTOR))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(words * power)])
    raw = upto[stop] - upto[start]
    # Divide by the power at the start: multiply by the inverse's power.
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    back = np.cumprod(np.full(len(words), inverse))
    mixed = raw * back[start]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _indexed(
    docs: DataFrame, kinds: DataFrame, span: int, shard_words: int
) -> DataFrame:
    """Repeats among the distinct stretches, by one FM-index per shard."""
    key = [docs.schema["id"], docs.schema["tie"]]
    total = kinds.agg(F.sum(F.col("windows") + span - 1)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    # Least hashes with more words than a shard are split by single windows, of which
    # equal ones still meet.
    large = written(
        kinds.groupBy("least")
        .agg(F.sum(F.col("windows") + span - 1).alias("words"))
        .where(F.col("words") > shard_words)
        .select("least", F.lit(True).alias("large")),
        "large",
    )
    # Start, number of windows and the mark in one number: a place takes two.
    packed = (
        F.shiftleft(F.col("first.start").cast("bigint"), 32)
        + F.col("windows") * 2
        + F.col("large").isNotNull().cast("int")
    )
    wanted = (
        kinds.join(large, "least", "left")
        .groupBy(F.col("first.id").alias("need"), F.col("first.tie").alias("at"))
        .agg(F.collect_list(F.struct("least", packed.alias("place"))).alias("parts"))
        .select(
            "need",
            "at",
            F.transform("parts", lambda p: p["least"]).alias("leasts"),
            F.transform("parts", lambda p: p["place"]).alias("places"),
        )
    )
    maybe, _, _ = _met(docs.select("id", "tie", "text"), written(wanted, "wanted"))
    texts = maybe.where("leasts is not null")
    schema = T.StructType(
        [
            *key,
            T.StructField("start", T.IntegerType()),
            T.StructField("bucket", T.LongType()),
            T.StructField("large", T.BooleanType()),
            T.StructField("words", T.ArrayType(T.LongType())),
        ]
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i) for i in (3, 4)]
            ends = np.cumsum(_lengths(lists[0]))
            own, place = (_flat(column) for column in lists)
            for low, high, found in word_ranges(batch, "text"):
                part = slice(int(ends[low - 1]) if low else 0, int(ends[high - 1]))
                text = np.searchsorted(ends, np.arange(part.start, part.stop), "right") - low
                at, many = place[part] >> 32, (place[part] & 0xFFFFFFFF) >> 1
                split = (place[part] & 1).astype(bool)
                # A split stretch is cut into each of its windows.
                cuts = np.where(split, many, 1)
                nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                text, at, split = (np.repeat(v, cuts) for v in (text, at, split))
                at = at + nth
                sizes = np.where(split, 1, np.repeat(many, cuts)) + span - 1
                words = found.hashes()
                begins = found.firsts()[text] + at
                bucket = np.repeat(own[part], cuts)
                if split.any():
                    windows = _run_hash(words, span, 1).view(np.int64)
                    bucket[split] = windows[begins[split]]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                inside = np.arange(int(offsets[-1])) + np.repeat(begins - offsets[:-1], sizes)
                take = pa.array(text + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array(at.astype(np.int32)),
                        pa.array(bucket),
                        pa.array(split),
                        pa.ListArray.from_arrays(
                            pa.array(offsets.astype(np.int32)),
                            pa.array(words[inside].view(np.int64)),
                        ),
                    ],
                    names=schema.fieldNames(),
                )

    indexed = texts.mapInArrow(lean(fetch), schema)
    again = None
    if not large.isEmpty():
        # Equal single windows are one before they go to a shard, the others repeats.
        cut = written(indexed, "windows")
        single = cut.where("large")
        row = F.struct("id", "tie", "start", "large", "words")
        firsts = single.groupBy("bucket").agg(F.min(row).alias("first"))
        place = F.struct("id", "tie", "start")
        again = (
            single.drop("words")
            .join(firsts, "bucket")
            .where(place != F.struct("first.id", "first.tie", "first.start"))
            .select("id", "tie", "start", (F.col("start") + span).alias("stop"))
        )
        indexed = cut.where("not large").unionByName(firsts.select("first.*", "bucket"))
    indexed = indexed.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)))
    result = T.StructType(
        [
            *key,
            T.StructField("start", T.IntegerType()),
            T.StructField("stop", T.IntegerType()),
        ]
    )

    def judge(rows: pa.Table) -> pa.Table:
        # In Arrow, not pandas, which makes numbers beside nulls inexact.
        keys = ["id", "tie", "start"]
        order = pc.sort_indices(
            rows, [(k, "ascending") for k in keys], null_placement="at_start"
        )
        rows = rows.take(order)
        # Rows that repeat a document bring its stretches again.
        rows = rows.filter(pa.array(~_repeated(rows.select(keys))))
        words = rows.column("words").combine_chunks()
        sizes = _lengths(words)
        earlier = _earlier(_flat(words).view(np.uint64), sizes, span)
        row, first, stop = _spans(earlier, sizes - span + 1, span)
        start = rows.column("start").to_numpy()[row]
        return pa.table(
            {
                "id": rows.column("id").take(pa.array(row)),
                "tie": rows.column("tie").take(pa.array(row)),
                "start": pa.array((start + first).astype(np.int32)),
                "stop": pa.array((start + stop).astype(np.int32)),
            }
        )

    repeats = (
        indexed.select("shard", "id", "tie", "start", "words")
        .groupBy("shard")
        .applyInArrow(judge, result)
    )
    return repeats if again is None else repeats.unionByName(again)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    """Elements of each list, none of null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _repeated(rows: pa.Table) -> np.ndarray:
    """Whether each row equals the one before it; nulls are equal."""
    same = np.ones(max(rows.num_rows - 1, 0), bool)
    for column in rows.columns:
        column = column.combine_chunks()
        left, right = column[1:], column[:-1]
        equal = pc.fill_null(pc.equal(left, right), False)
        both = pc.and_(pc.is_null(left), pc.is_null(right))
        same &= pc.or_(equal, both).to_numpy(zero_copy_only=False)
    return np.concatenate([np.zeros(min(rows.num_rows, 1), bool), same])


def _met(rows: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame, KeyFilter]:
    """``rows`` (id, tie and others) joined to ``few`` (need, at, one list or more), which
    has at most a row for each; texts without a row there are told by a filter of the
    keys, so they do not shuffle. Also the rows with their key, and that filter."""
    chosen = KeyFilter(few.select(F.xxhash64("need", "at").alias("key")))
    keyed = rows.withColumn("key", F.xxhash64("id", "tie"))
    met = F.col("id").eqNullSafe(F.col("need")) & (F.col("tie") == F.col("at"))
    joined = chosen.split(keyed, True).join(few, met, "left").drop("key", "need", "at")
    return joined, keyed, chosen


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, tie, n_words, n_removed, kept_text) of every row of ``docs``.

    Each word covered by a window of ``span`` words that also starts earlier, in a
    smaller id or further to the front, is removed; all windows are judged on the
    input. Kept words are joined by one space. ``tie`` orders rows that share an id, or
    have none, and null ids come first; rows equal in id and text are one document,
    given as often as they occur. Null and empty texts have no words. Other columns are
    not looked at; an empty table gives no row.
    """
    source = docs.select(
        F.col(doc_id).alias("id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tie"),
        F.col(text).cast("string").alias("text"),
    )
    spans = written(
        repeated_spans(source, span, gram, shard_words)
        .groupBy(F.col("id").alias("need"), F.col("tie").alias("at"))
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans")),
        "repeats",
    )
    maybe, keyed, chosen = _met(source, spans)
    others = keyed.select(
        "id", "tie", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "key"
    )
    choose = chosen.choosing(others, False)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("tie", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(_lengths(batch.column(3)))
            start, stop = (
                v.to_numpy(zero_copy_only=False) for v in batch.column(3).flatten().flatten()
            )
            for low, high, words in word_ranges(batch, "text"):
                part = slice(int(ends[low - 1]) if low else 0, int(ends[high - 1]))
                text = np.searchsorted(ends, np.arange(part.start, part.stop), "right") - low
                first, n = words.firsts(), len(words.starts)
                edge = np.bincount(first[text] + start[part], minlength=n + 1)
                edge -= np.bincount(first[text] + stop[part], minlength=n + 1)
                gone = np.cumsum(edge[:n]) > 0
                before = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(words.counts),
                        pa.array(before[first + words.counts] - before[first]),
                        joined(words, ~gone),
                    ],
                    names=schema.fieldNames(),
                )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return keep(choose(batches))

    return maybe.mapInArrow(lean(keep), schema).unionByName(
        others.mapInArrow(lean(whole), schema)
    )
