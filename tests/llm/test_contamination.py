"""Decontamination: planted passages are found, clean documents are not."""

import random

import numpy as np
import pytest
from corpus_words import sentence
from pyspark.sql import functions as F
from tidewheel.llm import contamination as ct


def brute_score(text, item):
    """Smith-Waterman, cell by cell."""
    best, rows = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            step = ct.MATCH if a == b else ct.OTHER
            rows[i][j] = max(
                0, rows[i - 1][j - 1] + step, rows[i - 1][j] + ct.GAP, rows[i][j - 1] + ct.GAP
            )
            best = max(best, rows[i][j])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    rng = random.Random(seed)
    item = np.array([rng.randrange(4) for _ in range(rng.randint(1, 14))], np.uint64)
    text = np.array([rng.randrange(4) for _ in range(rng.randint(1, 30))], np.uint64)
    score, start, stop = ct.align(text, item)
    assert score == brute_score(text.tolist(), item.tolist())
    assert score == brute_score(text[start:stop].tolist(), item.tolist())
    assert 0 <= start <= stop <= len(text)


def test_seeds_stay_for_items_that_leaked_often():
    items = ct.Items.of([(1, " ".join(f"w{i}" for i in range(20)))], 4, 8)
    often = {g: 1000 + i for i, g in enumerate(items.gram.tolist())}
    seeds = items.seeds(often, rare=5, stride=4)
    assert {p // 4 for p in seeds.place.tolist()} == {0, 1, 2, 3, 4}
    assert len(items.seeds(dict.fromkeys(often, 2), 5, 4).gram) == 17
    assert len(items.seeds({}, 5, 4).gram) == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    items = [sentence(rng, n) for n in (12, 25, 40, 90)]
    rows, wanted = [], set()

    def add(doc_id, words, item=None):
        rows.append((doc_id, " ".join(words)))
        if item is not None:
            wanted.add((doc_id, item))

    for i in range(60):
        add(i, sentence(rng, rng.randint(0, 300)))
    for k, item in enumerate(items):
        for j in range(4):
            around = [sentence(rng, rng.randint(0, 80)) for _ in range(2)]
            edited = list(item)
            for place in range(3 + j, len(item), 7):
                edited[place] = "other" if j % 2 else ""
            add(100 + 10 * k + j, around[0] + item + around[1], k)
            add(200 + 10 * k + j, around[0] + [w.upper() + "," for w in edited if w] + around[1], k)
    # A third of all documents hold one item, and a long one holds it many times.
    for i in range(60):
        add(300 + i, items[1] + sentence(rng, 20), 1)
    add(400, (items[2] + sentence(rng, 30)) * 60, 2)
    add(401, items[3][:60], 3)
    rows += [(None, " ".join(items[0])), (500, None), (501, ""), rows[64]]
    wanted.add((None, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gram", F.lit("g"))
    bench = [(i, " ".join(t)) for i, t in enumerate(items)]
    bench += [(7, bench[0][1]), (8, None), (9, ""), (10, "too short to tell")]
    wanted |= {(d, 7) for d, i in wanted if i == 0}
    return docs.repartition(4), spark.createDataFrame(bench, "item_id int, text string"), wanted


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_planted_passages(planted, block_words):
    docs, items, wanted = planted
    rows = ct.contaminated(docs, items, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == wanted
    assert len(rows) == len(wanted)
    whole = {r["doc_id"]: r for r in rows if r["item_id"] == 1 and (r["doc_id"] or 0) >= 300}
    assert all(r["score"] == 1 and (r["start"], r["stop"]) == (0, 25) for r in whole.values())


def test_empty_sides(planted):
    docs, items, _ = planted
    assert ct.contaminated(docs.limit(0), items).count() == 0
    none = ct.contaminated(docs, items.limit(0))
    assert none.count() == 0
    assert none.columns == ["doc_id", "item_id", "score", "start", "stop", "seeds"]
    keyed = ct.contaminated(docs, items.where("item_id > 7"), keys=["doc_id", "gram"])
    assert keyed.count() == 0 and keyed.columns[:2] == ["doc_id", "gram"]
