"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Best fit, longest first, is
carried out on the counts of each length instead of on pieces: bins with equal space
left are one range of sequence numbers, and a step fills part of a range or all of it
with pieces of one length. The plan is a list of runs: so many pieces of a length, from
this rank on, go to these sequences at this place. Pieces find their slot by their rank
within their length. The plan's size follows from the capacity, not from the data.

Ranks come from counts of (length, bin of a hash), so that a length that many pieces
share is sorted in many tasks.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import WordTokens, lean, tokenizer, written

CAPACITY = 4096
END_ID = 1
# Punctuation that may stand behind a word; no apostrophe, which contractions begin with.
TAIL = b".,;:!?)&\""


def tokenised_pieces(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of every row.

    A document is its tokens and ``end_id``; only longer ones are cut, every ``capacity``
    tokens. Words are encoded one by one: the vocabulary's pattern never spans white
    space. A null or empty text is the single id ``end_id``. Rows are taken one by one,
    null and repeated ids as they are.
    """
    fields = [
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordParts(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for low, high in by_size(sizes):
                tokens, upto = words.tokens(texts.slice(low, high - low), end_id)
                for i, (begin, stop) in enumerate(zip(upto[:-1], upto[1:]), low):
                    for k, at in enumerate(range(begin, stop, capacity)):
                        part = tokens[at : min(at + capacity, stop)]
                        row.append(i)
                        piece.append(k)
                        start.append(at - begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part.astype(np.int32))
            arrays = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(lean(run), schema)


def by_size(sizes: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes or one text each."""
    upto, low = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while low < len(sizes):
        high = max(int(np.searchsorted(upto, upto[low] + limit, "right")) - 1, low + 1)
        yield low, high
        low = high


def _is_letter(char: str) -> bool:
    """A letter that stays one in lower case; others grow marks behind them."""
    return char.isalpha() and len(char.lower()) == 1


# Letters that neither the composition of marks nor their neighbours change.
LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]


class WordParts:
    """Ids of words. A word falls into a core and the punctuation behind it, where the
    tokenizer parts them itself: most rare words come with and without punctuation, and
    in either case, so fewer are encoded. A core of Latin letters goes straight to the
    tokenizer's model, as its other steps only map such letters one by one. What is known
    ends with the task: kept by the workers it would take memory from the stages that
    follow."""

    def __init__(self, vocabulary: str):
        self.tok = tokenizer(vocabulary)
        self.folds = self._normal("Ab") == "ab"
        self.tails: dict[bytes, bool] = {}
        self.model, self.letters = self.tok.model, self._letters()
        self.plain = re.compile("[%s]+" % "".join(map(chr, self.letters)) if self.letters else "(?!)")
        self.cache = WordTokens(self._encode)

    def _normal(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def _letters(self) -> dict[int, str]:
        """What the model sees of each Latin letter, if it sees a run of them whole."""
        split = self.tok.pre_tokenizer
        added = self.tok.get_added_tokens_decoder().values()
        if split is None or any("<|" not in token.content for token in added):
            return {}
        seen = {}
        for char in LETTERS:
            normal = self._normal(char)
            pieces = split.pre_tokenize_str(normal)
            if len(normal) == 1 and len(pieces) == 1:
                seen[ord(char)] = pieces[0][0]
        run = "".join(map(chr, seen))
        for text in (run, run[::-1], run + run):
            whole = [piece for piece, _ in split.pre_tokenize_str(self._normal(text))]
            if whole != [text.translate(seen)]:
                return {}
        return seen

    def _parts_off(self, tail: bytes) -> bool:
        """Whether the tokenizer parts such punctuation from letters before it."""
        if tail not in self.tails:
            ahead, text = "ab", tail.decode()
            split = self.tok.pre_tokenizer
            alone = self._normal(text) == text and self._normal(ahead + text) == ahead + text
            pieces = split.pre_tokenize_str(ahead + text) if split and alone else []
            cuts = [span for _, span in pieces]
            self.tails[tail] = bool(cuts) and cuts[0] == (0, len(ahead)) and len(cuts) == 2
        return self.tails[tail]

    def folded(self, texts: pa.Array) -> pa.Array:
        """The texts in lower case, if the tokenizer takes them so. Special tokens are
        looked for in the text as it is."""
        if not self.folds:
            return texts
        special = pc.match_substring(texts, "<|")
        return pc.if_else(special, texts, pc.ascii_lower(texts))

    def parts(self, words: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Each word's core and the punctuation behind it, or the word and nothing."""
        trimmed = pc.ascii_rtrim(words, characters=TAIL.decode())
        cores = words.cast(pa.binary()).to_pylist()
        tails = [b""] * len(cores)
        shorter = pc.not_equal(pc.binary_length(trimmed), pc.binary_length(words))
        for i in np.flatnonzero(shorter.to_numpy(zero_copy_only=False)).tolist():
            word = cores[i]
            core = word.rstrip(TAIL)
            if not core or b"<|" in word:
                continue
            letter = core[-1:].isalpha() or (core[-1] > 127 and _is_letter(core.decode()[-1]))
            if letter and self._parts_off(word[len(core) :]):
                cores[i], tails[i] = core, word[len(core) :]
        return cores, tails

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        texts = [word.decode("utf-8", "replace") for word in words]
        whole, model, letters = self.plain.fullmatch, self.model.tokenize, self.letters
        ids = [
            [token.id for token in model(text.translate(letters))] if whole(text) else None
            for text in texts
        ]
        rest = [i for i, own in enumerate(ids) if own is None]
        # Where tokens lie in their word is not asked for.
        found = self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, own in zip(rest, found):
            ids[i] = own.ids
        return ids

    def tokens(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts behind each other, each text's followed by ``end_id``, and
        where each begins, with the end of all. The texts are split and their distinct
        words found for all at once; empty words, around a text, have no ids."""
        self.cache.make_room()
        split = pc.ascii_split_whitespace(self.folded(texts))
        coded = split.flatten().dictionary_encode()
        cores, tails = self.parts(coded.dictionary)
        known = np.empty((len(cores), 2), np.int32)
        known[:, 0] = self.cache.numbers(cores, len(cores))
        known[:, 1] = self.cache.numbers(tails, len(tails))
        self.cache.settle()
        numbers = known[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        ends = np.concatenate([[0], np.cumsum(self.cache.count[numbers], dtype=np.int64)])
        words = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        upto = ends[2 * np.concatenate([[0], np.cumsum(words, dtype=np.int64)])]
        # Behind each text one place is left for its end.
        upto += np.arange(len(upto))
        tokens = np.full(int(upto[-1]), end_id, "<u4")
        inside = np.ones(len(tokens), bool)
        inside[upto[1:] - 1] = False
        tokens[inside] = self.cache.ids(numbers)
        return tokens, upto.tolist()


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list]:
    """Best fit, longest first, over counts: for each length its runs (first rank,
    first sequence, offset), by rank; a run ends where the next begins."""
    runs: dict[int, list] = {}
    # Ranges (first sequence, sequences) by the space left in each of them, and the
    # spaces there are, smallest first.
    open_: dict[int, list[tuple[int, int]]] = {}
    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank, own = histogram[length], 0, []
        spaces = [s for s in open_ if s >= length and open_[s]]
        heapq.heapify(spaces)

        def put(first: int, many: int, space: int) -> None:
            """One piece into each of ``many`` sequences with ``space`` left."""
            nonlocal left, rank
            own.append((rank, first, capacity - space))
            left, rank = left - many, rank + many
            rest = space - length
            if rest:
                if not open_.get(rest) and rest >= length:
                    heapq.heappush(spaces, rest)
                open_.setdefault(rest, []).append((first, many))

        while left:
            while spaces and not open_[spaces[0]]:
                heapq.heappop(spaces)
            if spaces:
                space = spaces[0]
                first, many = open_[space].pop()
                take = min(left, many)
                if take < many:
                    open_[space].append((first + take, many - take))
                put(first, take, space)
                continue
            # No sequence has room: as many new ones as full ones of this length
            # need, and one more for what remains.
            each = capacity // length
            full = left // each
            many, pieces = (full, each) if full else (1, left)
            first, fresh, space = fresh, fresh + many, capacity
            for _ in range(pieces):
                own.append((rank, first, capacity - space))
                left, rank, space = left - many, rank + many, space - length
            if space:
                open_.setdefault(space, []).append((first, many))
        runs[length] = own
    return runs


def ranked_in_length(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank, from 0, among those of their length."""
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = pieces.withColumn("_hash", order).withColumn(
        "_bin", F.shiftrightunsigned(F.col("_hash"), 54).cast("int")
    )
    upto = (
        Window.partitionBy("_length")
        .orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        rows.groupBy(F.col("length").alias("_length"), F.col("_bin").alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    )
    in_bin = Window.partitionBy("length", "_bin").orderBy(
        "_hash", "doc_id", "piece", "start", "ids_crc32"
    )
    met = (F.col("length") == F.col("_length")) & (F.col("_bin") == F.col("_b"))
    return (
        rows.join(offsets, met)
        .withColumn("rank", F.row_number().over(in_bin) - 1 + F.col("_before"))
        .drop("_hash", "_bin", "_length", "_b", "_n", "_before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with ``sequence_id`` and its place ``offset`` in the sequence.

    ``pieces`` has the columns of ``tokenised_pieces``, and any others but ``rank`` are
    kept. It is read twice, so write it first. Pieces equal in all key columns may
    change places with each other. No piece gives no sequence.
    """
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows: one per length.
    runs = plan({r["length"]: r["n"] for r in counts.collect()}, capacity)
    lookup = {
        length: tuple(np.array(c, np.int64) for c in zip(*own))
        for length, own in runs.items()
    }
    ranked = ranked_in_length(pieces)
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType(
        [
            *kept,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    names = [f.name for f in kept]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(rank), np.int64)
            offset = np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                ranks, firsts, offsets = lookup[int(value)]
                run = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine] = firsts[run] + rank[mine] - ranks[run]
                offset[mine] = offsets[run]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1]
                + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=schema.fieldNames(),
            )

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def packed_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    capacity = options.get("capacity", CAPACITY)
    return pack(written(tokenised_pieces(docs, vocabulary, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from packed pieces that carry ``ids``. A sequence
    has at most the capacity of tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
