"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Within an overlap both
chunks are searched for a common pre-token boundary. The pre-tokeniser scans from left
to right and a match depends only on what follows its start, so two scans that share
one boundary are the same from there on: left of the first common boundary the tokens
of the left chunk count, from it on those of the right one. A boundary of the left
chunk is trusted only if it lies further from the chunk's cut end than any lookahead
or special string can reach. Where an overlap has no common boundary, it is widened
until it has one or the document ends.

Shorter documents are cut at the places that are boundaries in every scan: before a
single space between two characters that are not white space. Equal pieces are
encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import by_bytes, text_column, tokenizer

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


def lookahead(tok) -> int:
    """Characters behind a match that may have decided it: two for contractions and
    white space, or the longest special string."""
    special = [len(t.content) for t in tok.get_added_tokens_decoder().values()]
    return max([4, *special])


class Chunk:
    """One encoded stretch of a text, with the places its pre-tokens start at."""

    def __init__(self, tok, text: str, start: int, length: int):
        self.start = start
        self.end = min(start + length, len(text))
        encoding = tok.encode(text[start : self.end], add_special_tokens=False)
        self.n = len(encoding)
        self.before: dict[int, int] = {}
        last = None
        marks = zip(encoding.offsets, encoding.word_ids)
        for i, ((at, _), word) in enumerate(marks):
            if word is None or word != last:
                self.before.setdefault(start + at, i)
            last = word

    def tokens(self, left: int, right: int | None) -> int:
        return (self.n if right is None else self.before[right]) - self.before[left]


def count_chunked(
    tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> int:
    """Tokens of one text, by spliced chunks."""
    guard, total, left = lookahead(tok), 0, 0
    a = Chunk(tok, text, 0, chunk + overlap)
    while a.n:
        if a.end == len(text):
            return total + a.tokens(left, None)
        start, width = a.start + chunk, overlap
        while True:
            b = Chunk(tok, text, start, chunk + width)
            seam = min(
                (p for p in b.before if left <= p <= a.end - guard and p in a.before),
                default=None,
            )
            if seam is not None:
                break
            width *= 2
            a = Chunk(tok, text, a.start, chunk + width)
            if a.end == len(text):
                return total + a.tokens(left, None)
        total += a.tokens(left, seam)
        a, left = b, seam
    return total


class PieceCounts(dict):
    """Tokens of pieces, each encoded once; holds at most ``limit`` pieces plus those
    of one range of texts."""

    def __init__(self, tok, limit: int = 1_000_000):
        super().__init__()
        self.tok, self.limit, self.new = tok, limit, []

    def __missing__(self, piece: str) -> int:
        self[piece] = -1
        self.new.append(piece)
        return -1

    def count(self, texts: list[list[str]]) -> list[int]:
        if len(self) > self.limit:
            self.clear()
        for pieces in texts:
            for _ in map(self.__getitem__, pieces):
                pass
        fresh = self.tok.encode_batch(self.new, add_special_tokens=False)
        self.update(zip(self.new, map(len, fresh)))
        self.new = []
        return [sum(map(self.__getitem__, pieces)) for pieces in texts]


def pieces_of(text: str) -> list[str]:
    """The text cut before single spaces between characters that are not white
    space; a text with other spaces is one piece."""
    words = text.split(" ")
    if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
        if not text.strip():
            return [text] if text else []
        return _merged(words)
    return [words[0], *map(" ".__add__, words[1:])]


def _merged(words: list[str]) -> list[str]:
    pieces = [words[0]]
    for before, word in zip(words, words[1:]):
        if before and word and not before[-1].isspace() and not word[0].isspace():
            pieces.append(" " + word)
        else:
            pieces[-1] += " " + word
    return [p for p in pieces if p]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"),
) -> DataFrame:
    """Every row of ``docs`` with its UTF-8 bytes, its tokens and whether they exceed
    ``limit``.

    A null or empty text has 0 bytes and 0 tokens. Rows are judged one by one, so
    repeated rows and null ids stay as they are; columns of ``docs`` named like an
    output are replaced. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in out]
    source = docs.select(*kept, F.col(text).cast("string").alias(out[1]))
    schema = docs.select(
        *kept,
        F.lit(0).cast("bigint").alias(out[0]),
        F.lit(0).cast("bigint").alias(out[1]),
        F.lit(False).alias(out[2]),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        cache = PieceCounts(tok)
        for batch in batches:
            texts = text_column(batch, out[1])
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for start, end in by_bytes(texts):
                own = texts[start:end]
                short = cache.count(
                    [pieces_of(t) if len(t) <= chunk_chars else [] for t in own]
                )
                counts += [
                    n
                    if len(t) <= chunk_chars
                    else count_chunked(tok, t, chunk_chars, overlap_chars)
                    for t, n in zip(own, short)
                ]
            columns = batch.columns[:-1] + [
                pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out])

    return source.mapInArrow(run, schema)
