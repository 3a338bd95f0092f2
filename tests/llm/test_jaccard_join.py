"""The similarity join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from corpus_words import sentence
from pyspark.sql import functions as F
from tidewheel.llm import jaccard_join as jj
from tidewheel.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < jj.WIDTH:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + jj.WIDTH]) for i in range(len(words) - jj.WIDTH + 1))


def brute(rows):
    """Per row its set's size and the least id of its component."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= jj.PERCENT * (len(a) + len(b) - both):
                group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        own = least.get(find(i))
        if doc_id is not None and (own is None or doc_id < own):
            least[find(i)] = doc_id
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def families(seed, size):
    """Copies edited at all rates, chains, shared passages, short texts, odd rows."""
    rng = random.Random(seed)
    passage = sentence(rng, 50)
    texts = [" ".join(sentence(rng, rng.randint(1, 90))) for _ in range(size)]
    for edits in (1, 3, 6, 12, 25):
        base = sentence(rng, 150)
        for _ in range(size // 4):
            near = list(base)
            for _ in range(rng.randint(0, edits)):
                near[rng.randrange(len(near))] = f"e{rng.random()}"
            texts.append(" ".join(near))
    chain = sentence(rng, 80)
    for _ in range(size // 3):
        chain = chain[1:] + sentence(rng, 1)
        texts.append(" ".join(chain))
    texts += [" ".join(passage + sentence(rng, rng.randint(2, 30))) for _ in range(size)]
    short = sentence(rng, 14)
    texts += [" ".join(short[: rng.randint(1, 14)] + sentence(rng, rng.randint(0, 2))) for _ in range(2 * size)]
    texts += ["A b C", "a B c", "a b c d e", "A B C D E", "", None, " \t", "a\xa0b c", "a b c"]
    texts += [texts[0]] * size
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (None, texts[1]), (None, "nobody else says this"), rows[0], (5000, texts[2])]


@pytest.mark.parametrize("seed, frequent, block", [(1, 32, 1 << 18), (2, 2, 900)])
def test_components(spark, monkeypatch, seed, frequent, block):
    monkeypatch.setattr(jj, "BLOCK_TOKENS", block)
    rows = families(seed, 24)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1))
    found = jj.near_duplicates(docs.repartition(6), frequent=frequent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = families(3, 12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("root", F.lit("r"))
    kept = jj.one_of_each(docs.repartition(3))
    found = kept.collect()
    assert kept.columns == docs.columns
    wordy = [r["doc_id"] for r in found if shingle_set(r["text"])]
    components_ = {c for (_, n, c) in brute(rows) if n}
    assert set(wordy) == components_ and len(wordy) == len(components_)
    bare = [r for r in rows if not shingle_set(r[1])]
    assert len(found) - len(wordy) == len(bare)
    assert jj.one_of_each(docs.limit(0)).count() == 0
    assert jj.near_duplicates(docs.limit(0)).count() == 0


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(2)
    left = [np.unique(rng.integers(-60, 60, rng.integers(1, 50))) for _ in range(9)]
    right = [np.unique(rng.integers(-60, 60, rng.integers(1, 50))) for _ in range(5)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert jj.overlaps(left, right).tolist() == expected
    assert jj.overlaps([np.array([1])], [np.array([2])]).tolist() == [[0]]


def test_components_of_any_shape(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    links += [(300 + i, 301 + i) for i in range(60)] + [(999, 400 + i) for i in range(50)] + [(7, 7)]
    group = {x: x for pair in links for x in pair}

    def find(x):
        return x if group[x] == x else find(group[x])

    for a, b in links:
        group[find(a)] = find(b)
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(rows) == len({x for a, b in links if a != b for x in (a, b)})
    by = {}
    for r in rows:
        by.setdefault(r["root"], set()).add(find(r["node"]))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({find(r["node"]) for r in rows})
