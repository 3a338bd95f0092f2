"""What the text operators share: words, per-task word caches, written intermediates."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache, wraps
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.session import scratch_path

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and
# carriage return: just what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the library to the Python workers, as --py-files would, once a session."""
    context = spark.sparkContext
    if any(name.endswith("/tidewheel.zip") for name in context.listFiles):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidewheel-")) / "tidewheel.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage and
    survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a batch that are worked on at a time.
ROWS = 1_000
Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` on a few rows at a time, so that texts are not there several times over by
    the batch. What its task had is given back to the system at its end: else the
    worker would hold it beside the stages that follow."""

    @wraps(run)
    def steps(batches: Batches) -> Batches:
        yield from run(
            whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)
        )
        release()

    return steps


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python by ROWS rows at most: Spark's 10,000 texts
    or sets would be held by the executor, and by its worker, at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), ROWS) if int(before) > 0 else ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# Bytes of strings and numbers that may be broadcast.
BROADCAST_BYTES = 1 << 27


def octets(df: DataFrame) -> Column:
    """About the bytes of a row: the lengths of its strings, also of those in arrays, and
    eight for all else."""
    found = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind, name = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            name, kind = F.array_join(name, ""), kind.elementType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            found += F.coalesce(F.octet_length(name), F.lit(0))
        else:
            found += F.lit(8)
    return found


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc32_of(text: Column) -> Column:
    return F.crc32(text.cast("binary")).cast("bigint")


def utf8_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    column = batch.column(batch.schema.get_field_index(name))
    return [v or "" for v in column.to_pylist()]


def by_bytes(texts: Sequence, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters or one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer of the tokenizers library, once per worker, on one thread: the
    cores belong to Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens(dict):
    """Token ids of words, each encoded once: word -> number of the word.

    ``settle`` encodes the words met since the last call in one batch; ``ids`` then
    strings the words' ids together without a loop. A cache holds at most ``limit``
    words plus those of one range of texts.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 1_000_000):
        super().__init__()
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.used = self.filled = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def numbers(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, n)

    def make_room(self) -> None:
        """Before a range of texts; numbers given out earlier end here."""
        if len(self) > self.limit:
            self._reset()

    def settle(self) -> None:
        if not self.new:
            return
        lists = self.encode(self.new)
        counts = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
        n, filled = len(self), self.filled + len(flat)
        self.start, self.count = _room(self.start, n), _room(self.count, n)
        self.pool = _room(self.pool, filled)
        self.pool[self.filled : filled] = flat
        ends = np.cumsum(counts, dtype=np.int64)
        self.start[self.used : n] = self.filled + ends - counts
        self.count[self.used : n] = counts
        self.used, self.filled, self.new = n, filled, []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.count[numbers]
        ends = np.cumsum(counts, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.start[numbers] - (ends - counts), counts)
        return self.pool[np.arange(total) + shift]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    grown = np.zeros(max(n, 2 * len(array)), array.dtype)
    grown[: len(array)] = array
    return grown
