"""The words of many texts at once: places in their bytes, found and hashed in NumPy.

Neither texts nor words become Python objects, so there is no cache of words that a
worker would hold, and a word costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes of texts that are worked on at once.
RANGE_BYTES = 1 << 19
# Words of more bytes are hashed one by one.
LONG_WORD = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# The first 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass(frozen=True)
class Words:
    """``data`` are the bytes of texts, word ``i`` those from ``starts[i]`` to
    ``stops[i]``; ``counts`` are the words of each text."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    counts: np.ndarray

    def firsts(self) -> np.ndarray:
        """The number of each text's first word."""
        return np.cumsum(self.counts) - self.counts

    def lowered(self) -> Words:
        """The same with A-Z in lower case."""
        upper = (self.data - np.uint8(65)) < 26
        return Words(self.data + (upper * np.uint8(32)), self.starts, self.stops, self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        lengths = self.stops - self.starts
        padded = np.zeros(len(self.data) // 8 * 8 + 16, np.uint8)
        padded[: len(self.data)] = self.data
        eights = padded.view("<u8")

        def piece(at: np.ndarray, size: np.ndarray) -> np.ndarray:
            """The up to eight bytes from each place on, as numbers."""
            block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            low = eights[block] >> shift
            # In two steps, as a shift by 64 is none.
            high = eights[block + 1] << (np.uint64(63) - shift) << np.uint64(1)
            return (low | high) & _MASKS[np.minimum(size, 8)]

        mixed = piece(self.starts, lengths) ^ (lengths.astype(np.uint64) * _MIX)
        mixed *= _FACTOR
        mixed ^= mixed >> np.uint64(32)
        short = lengths <= LONG_WORD
        for done in range(8, LONG_WORD, 8):
            more = np.flatnonzero(short & (lengths > done))
            if not len(more):
                break
            own = (mixed[more] ^ piece(self.starts[more] + done, lengths[more] - done)) * _FACTOR
            mixed[more] = own ^ (own >> np.uint64(32))
        for i in np.flatnonzero(~short):
            word = self.data[self.starts[i] : self.stops[i]]
            mixed[i] = xxhash.xxh64_intdigest(word.tobytes())
        mixed *= _MIX
        return mixed ^ (mixed >> np.uint64(29))


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of words: all but space and 9 to 13, at which bytes.split() splits."""
    return ((data - np.uint8(9)) > 4) & (data != 32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts that lie behind each other, from ``offsets[i]`` to the next."""
    inside = _inside(data)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # No word goes on from one text to the next.
    filled = np.diff(offsets) > 0
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[first], ends[last] = inside[first], inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, starts, stops, np.diff(np.searchsorted(starts, offsets)))


def word_ranges(
    batch: pa.RecordBatch, name: str, limit: int = RANGE_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """Ranges of rows of about ``limit`` bytes or one text each, with the words of their
    texts; null has none."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values or b"", np.uint8)
    low = 0
    while low < len(column):
        fit = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        # Empty texts behind the last that fits come along.
        high = min(max(low + 1, fit), len(column))
        start, stop = int(offsets[low]), int(offsets[high])
        yield low, high, words_of(data[start:stop], offsets[low : high + 1] - start)
        low = high


def joined(words: Words, stay: np.ndarray) -> pa.Array:
    """Per text the words that stay, by one space between two; bytes that are no UTF-8
    are replaced."""
    kept = np.flatnonzero(stay)
    text = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    starts, stops = words.starts[kept], words.stops[kept]
    # A word with another behind it in its text takes the byte at its end, a space then.
    follow = np.append(text[1:] == text[:-1], False)[: len(kept)]
    data = words.data.copy()
    data[stops[follow]] = 32
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[stops + follow] -= 1
    flat = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    sizes = np.zeros(len(words.counts), np.int64)
    np.add.at(sizes, text, stops - starts + follow)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    )
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in found.to_pylist()], pa.string())
