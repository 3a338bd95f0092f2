"""Quality rules by tokeniser fertility.

A public vocabulary cuts every word into tokens. Text of a script that the vocabulary
was built from gets long tokens, few byte fallbacks and a rich mix of tokens; shouting,
symbol noise, wrong encodings and machine strings do not. The measures of a document
must lie within the band of its language, or else of its script.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import WordTokens, by_bytes, lean, utf8_column

WINDOW = 8
ENTROPY_TOKENS = 256
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Band:
    """What a text may measure. ``entropy`` is the least entropy of the document's
    tokens, as ``entropy_share`` scales it; it is asked of texts of at least
    ``least_tokens``, as is the length of tokens."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    least_tokens: int = 48


# Bounds lie well outside what running text measures with the 32,000 piece vocabulary:
# 1.76 to 2.4 characters a token and an entropy of 0.75 to 0.94 in the four languages of
# the test documents, up to about 5 characters in English.
BANDS: Mapping[str, Band] = {
    "latin": Band((1.6, 7.0), 0.12, 0.68),
    "cyrillic": Band((1.2, 6.0), 0.15, 0.60),
    "greek": Band((0.8, 4.0), 0.30, 0.50),
    "arabic": Band((0.7, 4.0), 0.40, 0.45),
    "hebrew": Band((0.7, 4.0), 0.40, 0.45),
    "devanagari": Band((0.6, 4.0), 0.60, 0.45),
    "hangul": Band((0.4, 3.0), 0.85, 0.45),
    "cjk": Band((0.4, 2.5), 0.85, 0.50),
    "other": Band((0.3, 8.0), 0.95, 0.40),
}
# Where the blocks of Unicode that tell scripts apart begin.
BLOCKS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "other"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "other"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "cjk"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "cjk"),
    (0xFB00, "other"),
    (0x20000, "cjk"),
    (0x30000, "other"),
]
_STARTS = np.array([start for start, _ in BLOCKS])
_NAMES = [name for _, name in BLOCKS]


@lru_cache(maxsize=4)
def pieces(vocabulary: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return model, is_byte


def script_of(text: str) -> str:
    """The script of most letters; Latin if there are none."""
    if text.isascii():
        return "latin"
    letters = "".join(filter(str.isalpha, text))
    points = np.frombuffer(letters.encode("utf-32-le", "ignore"), "<u4")
    if not len(points):
        return "latin"
    votes = np.bincount(
        np.searchsorted(_STARTS, points, "right") - 1, minlength=len(_NAMES)
    )
    totals: dict[str, int] = {}
    for name, n in zip(_NAMES, votes.tolist()):
        totals[name] = totals.get(name, 0) + n
    return max(totals, key=totals.get)


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the document."""
    n = len(numbers)
    if n <= window:
        return 0
    ranks, span = numbers, 1
    while span < window:
        step = min(span, window - span)
        pairs = ranks[: len(ranks) - step].astype(np.int64) << 32 | ranks[step:]
        order = np.argsort(pairs, kind="stable")
        new = np.empty(len(pairs), bool)
        new[0] = False
        np.not_equal(pairs[order][1:], pairs[order][:-1], out=new[1:])
        if new[1:].all():
            return 0
        ranks = np.empty(len(pairs), np.int32)
        ranks[order] = np.cumsum(new)
        span += step
    often = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def entropy_share(ids: np.ndarray) -> float:
    """Entropy of the ids over that of as many different ones, or of ENTROPY_TOKENS, as
    the entropy of running text hardly grows beyond; 1 for fewer than two."""
    if len(ids) < 2:
        return 1.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    most = np.log2(min(len(ids), ENTROPY_TOKENS))
    return float(-(p * np.log2(p)).sum() / most)


def fertility_quality(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    lang: str | None = "lang",
    bands: Mapping[str, Band] = BANDS,
    least_words: int = 20,
    repeat_percent: int = 30,
) -> DataFrame:
    """Every row of ``docs`` with its measures and the verdict ``kept``.

    ``bands`` is asked for the row's language first, then for its script. A row fails
    at once (``base_failed``) with fewer than ``least_words`` words or more than
    ``repeat_percent`` per cent of its words in repeated windows. A null or empty text
    has no words and fails. A null language goes by script. Rows are judged one by
    one; equal rows get equal verdicts. Columns of ``docs`` named like an output are
    replaced; an empty table gives an empty table.
    """
    added = [
        T.StructField(name, T.LongType())
        for name in (
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
        )
    ]
    added += [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("script", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name not in names]
    spoken = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    source = docs.select(
        *[f.name for f in kept],
        spoken.alias("token_entropy"),
        F.col(text).cast("string").alias("kept"),
    )
    bands = dict(bands)

    def judge(doc: bytes, numbers: np.ndarray, tokens: np.ndarray, is_byte, spoken):
        decoded = doc.decode("utf-8", "replace")
        n = len(numbers)
        chars = len(decoded) - sum(map(decoded.count, SPACES))
        symbols = sum(map(decoded.count, SYMBOLS))
        repeats = repeated_words(numbers)
        failed = n < least_words or 100 * repeats > repeat_percent * n
        script = script_of(decoded)
        band = bands.get(spoken) or bands.get(script) or bands["other"]
        length = chars / len(tokens) if len(tokens) else 0.0
        share = float(is_byte[tokens].mean()) if len(tokens) else 0.0
        entropy = entropy_share(tokens)
        good = not failed and share <= band.byte_share
        if good and len(tokens) >= band.least_tokens:
            low, high = band.chars_per_token
            good = low <= length <= high and entropy >= band.entropy
        return (
            n,
            chars,
            symbols,
            repeated_lines(doc),
            repeats,
            failed,
            script,
            len(tokens),
            length,
            share,
            entropy,
            good,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, is_byte = pieces(vocabulary)
        cache = WordTokens(
            lambda words: model.encode(
                [w.decode("utf-8", "replace") for w in words], num_threads=1
            )
        )
        for batch in batches:
            texts = utf8_column(batch, "kept")
            spoken = batch.column(len(kept)).to_pylist()
            rows = []
            for start, end in by_bytes(texts):
                cache.make_room()
                numbers = []
                for doc in texts[start:end]:
                    words = doc.split()
                    numbers.append(cache.numbers(words, len(words)))
                cache.settle()
                for doc, own, said in zip(
                    texts[start:end], numbers, spoken[start:end]
                ):
                    rows.append(judge(doc, own, cache.ids(own), is_byte, said))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            arrays = [
                pa.array(values, kind)
                for values, kind in zip(
                    columns,
                    [pa.int64()] * 5
                    + [pa.bool_(), pa.string(), pa.int64()]
                    + [pa.float64()] * 3
                    + [pa.bool_()],
                )
            ]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-2] + arrays, names=[*[f.name for f in kept], *names]
            )

    return source.mapInArrow(lean(run), T.StructType([*kept, *added]))
