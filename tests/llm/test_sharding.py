"""Interleaving against a plain sort."""

import hashlib
from collections import Counter

from tidewheel.llm import sharding


def brute(rows, shards, seed=0):
    def key(r):
        texts = ["" if v is None else str(v) for v in (r["doc_id"], r["text"])]
        return hashlib.md5("\x1f".join([str(seed), *texts]).encode()).hexdigest()

    by = {}
    for r in rows:
        by.setdefault("" if r["source"] is None else "=" + r["source"], []).append(key(r))
    order = []
    for source, keys in by.items():
        for rank, k in enumerate(sorted(keys), 1):
            order.append(((2 * rank - 1) / (2 * len(keys)), k, source))
    order.sort()
    return Counter((k, i * shards // len(order)) for i, (_, k, _) in enumerate(order)), key


def test_places_are_those_of_the_whole_order(corpus, nothing):
    rows = corpus.collect()
    for shards in (1, 7, 500):
        expected, key = brute(rows, shards)
        placed = sharding.interleaved(corpus, shards, "source", ["doc_id", "text"])
        found = placed.collect()
        assert Counter((key(r), r["shard"]) for r in found) == expected
        assert placed.columns == [*corpus.columns, "shard", "slot"]
        sizes = Counter(r["shard"] for r in found)
        if shards <= len(rows):
            assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1
        for shard, n in sizes.items():
            assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    assert sharding.interleaved(nothing, 4, "source", ["doc_id"]).count() == 0


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 10}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    found = sharding.interleaved(docs, 10, "source", ["doc_id"]).collect()
    whole = Counter(r["source"] for r in found)
    for shard in range(10):
        own = Counter(r["source"] for r in found if r["shard"] == shard)
        assert all(abs(own[s] - n / 10) <= 2 for s, n in whole.items())


def test_seed_changes_the_order_and_files_hold_the_texts(corpus, tmp_path, spark):
    one = sharding.interleaved(corpus, 4, "source", ["doc_id", "text"], seed=1)
    two = sharding.interleaved(corpus, 4, "source", ["doc_id", "text"], seed=2)
    place = lambda df: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in df.collect())
    assert place(one) != place(two)
    path = str(tmp_path / "shards")
    sharding.write_shards(one, path, ["doc_id", "text"])
    back = spark.read.parquet(path)
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] for r in corpus.collect())
