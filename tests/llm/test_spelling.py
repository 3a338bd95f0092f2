"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def plain(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            digest = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if digest % 97 == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    found = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return found


def result(docs, **options):
    rows = spelling.spelling_variants(docs, **options).collect()
    found = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stems = ["".join(rng.choices("abcdeé×ÿ", k=rng.randint(4, 9))) for _ in range(25)]
    stems += ["aaaaaa", "aaaaa", "ababab", "ÀÉÎÕü", "straße", "a" * 70, "a" * 69, "b" + "a" * 69]
    out = []
    for i in range(200):
        words = []
        for _ in range(60):
            word = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "a", "é", word[at] * 2]) + word[at + 1 :]
            words.append(word.upper() if rng.random() < 0.1 else word)
        # Between the words stand characters whose bytes also end letters.
        out.append((i, rng.choice([" ", " ", "’", "1", "Ā", "😀"]).join(words)))
    out += [(None, "nulls count here here here"), (7, None), (8, ""), (9, out[3][1]), (9, out[3][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, "w", 1, "f") for i, t in rows]
    schema = "doc_id bigint, text string, word string, n int, form string"
    return spark.createDataFrame(wide, schema).repartition(4)


@pytest.fixture(scope="module")
def expected(rows):
    return plain(rows)


def test_equals_plain(docs, expected):
    assert result(docs) == expected
    assert any(form and root != form for _, _, _, form, _, root in expected)


def test_passes_and_parts_change_nothing(docs, expected, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 5)
    assert result(docs, limit=40) == expected


def test_counts_handed_on_in_pieces(rows, expected, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "COUNTED", 3)
    names = ["" if i is None else str(i) for i, _ in rows]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array([t for _, t in rows], pa.string())], ["id", "text"]
    )
    counts = Counter()
    for part in spelling._counted([batch]):
        for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            counts[word] += n
    assert {w: n for w, n in counts.items() if n >= 3} == {w: n for w, n, *_ in expected}


def test_empty_table(docs):
    assert result(docs.limit(0)) == set()


def test_filter_misses_nothing_and_seldom_errs():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    keys, part = spelling._key(hashes, 3)
    bits = {}
    for p in range(3):
        shard = spelling.pd.DataFrame({"key": keys[part == p].view(np.int64), "letters": "a"})
        bits[p] = spelling._built(shard.assign(**{"class": 8, "part": p}))["bits"].iloc[0]
    filters = spelling.Filters(bits, 3)
    assert filters.hold(hashes).all()
    assert filters.hold(rng.integers(1 << 63, 1 << 64, 100_000, dtype=np.uint64)).mean() < 0.02
    assert not spelling.Filters({0: bits[0]}, 3).hold(hashes[part == 1]).any()


def test_very_long_text_and_word(spark):
    long = "z" * 200_000
    rows = [(1, "lorem ipsum " * 100_000), (2, long), (3, long), (4, long + "z"), (5, long + " " + long + "z ") , (6, long + "z")]
    counts = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert sum(counts.values()) == 200_000 + 6
    small = [(i, "z" * 3000 + " " + "z" * 2999) for i in range(8)]
    found = result(spark.createDataFrame(small, "doc_id int, text string"))
    assert found == plain(small)
