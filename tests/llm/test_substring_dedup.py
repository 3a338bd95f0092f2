"""Substring dedup against a plain scan, and the index against counting."""

import random

import numpy as np
import pytest
from corpus_words import sentence
from pyspark.sql import functions as F
from tidewheel.llm import substring_dedup as sd


def brute(rows, span):
    """What is left of each text when windows seen earlier go, in order of the rows."""
    seen, out = set(), {}
    for key, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            if window in seen:
                gone[i : i + span] = [True] * span
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out[key] = (len(words), sum(gone), kept)
    return out


def test_repeats_of_all_kinds(spark, texts):
    rng = random.Random(6)
    passage = sentence(rng, 60)
    rows = list(enumerate(texts))
    for i in range(30):
        words = sentence(rng, 40) + passage[rng.randint(0, 30) :] + sentence(rng, 10)
        rows.append((200 + i, " ".join(words)))
    rows += [(300, "go " * 25), (301, "go " * 19), (302, "a b " * 40), (303, "x\xa0y " * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(0))
    expected = brute(rows, 20)
    for shard_words in (300_000, 2_000, 60):
        found = sd.without_repeats(docs.repartition(5), shard_words=shard_words).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found} == expected
    assert sum(n for _, n, _ in expected.values()) > 1000


def test_repeated_and_missing_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, one), (None, two), (2, two), (3, None), (3, ""), (2, one)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in sd.without_repeats(docs).collect()]
    # Equal rows are one document; a missing id comes first.
    assert sorted(found, key=str) == sorted(
        [(1, 30, 0), (1, 30, 0), (None, 30, 0), (2, 30, 30), (3, 0, 0), (3, 0, 0), (2, 30, 30)], key=str
    )
    assert sd.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, rng.choice([2, 4, 60]) + 1, rng.integers(3, 60)) for _ in range(6)]
    joined = np.concatenate([np.append(t, 0) for t in texts])
    index = sd.FmIndex(joined, int(joined.max()))
    ends = np.flatnonzero(joined) + 1
    depth = 7
    matched, found, low, high = index.search(joined, ends, depth)
    line = joined.tolist()

    def count(part):
        return sum(line[i : i + len(part)] == part for i in range(len(line) - len(part) + 1))

    for end, got in zip(ends.tolist(), matched.tolist()):
        longest = 0
        for n in range(1, depth + 1):
            part = line[max(0, end - n) : end]
            if len(part) < n or 0 in part or count(part) < 2:
                break
            longest = n
        assert got == longest
    firsts = index.earliest(low, high)
    for k, place, n in zip(found.tolist(), firsts.tolist(), (high - low).tolist()):
        part = line[ends[k] - depth : ends[k]]
        assert n == count(part)
        assert line[place : place + depth] == part
        assert place == next(i for i in range(len(line)) if line[i : i + depth] == part)


def test_suffixes_are_sorted_as_deep_as_searched():
    """A long repeat costs no more rounds than the span asks for."""
    text = np.append(np.ones(5000, np.int64), 0)
    order = sd._suffix_array(text, 20)
    # By 32 words of 5,001, so most suffixes are still equal and in any order.
    assert sorted(order.tolist()) == list(range(5001))
    words = [np.full(400, 7, np.uint64), np.arange(30, dtype=np.uint64)]
    first, other = sd.repeated_windows(words, 20)
    assert first.tolist() == [False] + [True] * 380 and not other.any()


def test_stretches_of_several_texts_are_those_of_each():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, k, n).astype(np.uint64) for k, n in ((5, 90), (900, 20), (3, 41))]
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    least, starts, windows, twice = sd.stretches(np.concatenate(texts), 20, 6, sizes)
    each = [sd.stretches(t, 20, 6) for t in texts]
    assert starts.tolist() == [b + s for b, e in zip(begins, each) for s in e[1].tolist()]
    for own, nth in ((least, 0), (windows, 2), (twice, 3)):
        assert own.tolist() == [v for e in each for v in e[nth].tolist()]


def test_stretches_take_every_window_once():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    least, starts, windows, _ = sd.stretches(words, 20, 6)
    assert windows.sum() == 381 and (starts == np.cumsum(windows) - windows).all()
    rank = sd.BitRank(words > 2)
    at = np.arange(401)
    assert (rank.rank(at) == np.concatenate([[0], np.cumsum(words > 2)])).all()
