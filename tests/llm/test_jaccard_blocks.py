"""The similarity join's blocks and parts stay bounded whatever the sets."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_jaccard_join import brute, families
from tidewheel.llm import jaccard_join as jj

SETS = 20_000


def variants(n):
    """Texts of 25 words with two slots, each filled from a few hundred names: none link."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(30)]
    filled = rng.sample([(a, b) for a in range(300) for b in range(300)], n)
    for a, b in filled:
        words = list(template)
        words[9], words[19] = f"a{a}", f"b{b}"
        yield " ".join(words)


def test_blocks_of_short_sets_are_bounded_by_sets(spark):
    sets = spark.range(SETS).select(
        F.col("id").cast("string").cast("binary").alias("digest"), F.lit(26).cast("bigint").alias("n")
    )
    star = sets.select(F.col("digest").alias("a"), F.lit(b"0").alias("b")).where("a != b")
    rows = jj._blocks(jj._families(sets, star)).groupBy("family", "block").count().collect()
    assert len({r["family"] for r in rows}) == 1
    assert sum(r["count"] for r in rows) == SETS
    assert max(r["count"] for r in rows) < 1.25 * 4096


def test_parts_grow_in_number_not_in_size(spark, monkeypatch):
    # Small bounds stand for a large input: 200 thousand tokens in families of 20 sets.
    monkeypatch.setattr(jj, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(jj, "GROUP_TOKENS", 2000, raising=False)
    sets = spark.range(SETS).select(
        F.col("id").cast("string").cast("binary").alias("digest"), F.lit(10).cast("bigint").alias("n")
    )
    number = F.col("digest").cast("string").cast("bigint")
    centre = (number - number % 20).cast("string").cast("binary")
    star = sets.select(F.col("digest").alias("a"), centre.alias("b")).where("a != b")
    blocks = jj._blocks(jj._families(sets, star))
    part = "part" if "part" in blocks.columns else F.pmod("block", F.lit(jj.GROUPS))
    tokens = [10 * r["count"] for r in blocks.groupBy(part).count().collect()]
    assert sum(tokens) == 10 * SETS
    assert max(tokens) < 2.5 * 2000


def block(rng, n):
    """Sets of a template, some of them copies of one another, each a group of its own."""
    cache = jj.WordHashes()
    tokens = [jj.shingles(t.encode(), cache).view(np.int64) for t in variants(n)]
    names = [i.to_bytes(4, "big") for i in range(n)]
    for k in range(0, n, 1000):
        tokens[k + 1] = tokens[k]
    return pd.DataFrame({"digest": names, "root": names, "tokens": tokens})


def test_signatures_are_linear_in_a_sets_tokens(spark):
    """Two sets that share everything, all of it frequent: combinations a token stay few."""
    found = {}
    for n in (2_000, 16_000):
        rows = spark.range(n).select(
            F.xxhash64("id").alias("token"),
            F.explode(F.array(*[F.lit(d.encode()) for d in "ab"])).alias("digest"),
            F.lit(4 * n).cast("bigint").alias("n"),
        )
        rows = rows.withColumns({"root": F.col("digest"), "family": F.col("digest")})
        signed = jj._signatures(rows, 80, 1)
        found[n] = signed.count() / (2 * n)
        pairs = jj._pairs_across(signed, 80).collect()
        assert [(bytes(r["a"]), bytes(r["b"])) for r in pairs] == [(b"a", b"b")]
    assert max(found.values()) < 8


def test_a_hot_group_of_edited_copies_pairs_in_proportion(spark, monkeypatch):
    """Copies that link and texts that only share a passage leave few pairs across."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(300)]
    seen = []
    pairs_across = jj._pairs_across
    monkeypatch.setattr(jj, "_pairs_across", lambda *a: seen.append(pairs_across(*a)) or seen[-1])
    rows = []
    for _ in range(300):
        near = list(base)
        near[rng.randrange(300)] = f"e{rng.random()}"
        rows += [" ".join(near), " ".join([*passage, *(f"o{rng.random()}" for _ in range(60))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in jj.near_duplicates(docs.repartition(6)).collect()}
    assert found == {i: 0 if i % 2 == 0 else i for i in range(600)}
    assert seen[0].count() < 600


def test_components_by_many_parts(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(jj, "GROUP_TOKENS", 60)
    rows = families(5, 12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jj.near_duplicates(docs.repartition(6)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows)


def test_memory_of_a_pair_of_blocks_is_that_of_a_strip():
    part = block(random.Random(1), 8000)
    tracemalloc.start()
    links = jj.links_between(part, part, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = {(k, k + 1) for k in range(0, 8000, 1000)}
    assert {tuple(sorted(int.from_bytes(x, "big") for x in r)) for r in links.values} == expected
    assert len(links) == len(expected)
    # One matrix of all by all takes 512 MB.
    assert peak < 450_000_000


def test_tens_of_thousands_of_variants_of_a_template(spark):
    texts = list(variants(SETS))
    rows = [*enumerate(texts), (SETS, texts[7]), (SETS + 1, texts[9] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in jj.near_duplicates(docs).collect()}
    expected = {i: i for i in range(SETS)} | {SETS: 7, SETS + 1: 9}
    assert found == expected


def test_equal_sets_are_one_after_few_are_left(spark):
    """Sets come as rows are, and of equal ones that share enough one stays."""
    rows = [(bytes([k]), 10, [1, 2, 3, 4, 5, 6, 7]) for k in (1, 1, 2)]
    rows += [(b"x", 10, [90, 91, 92, 93, 94, 95, 96])]
    sets = spark.createDataFrame(rows, "digest binary, n bigint, tokens array<bigint>")
    found = jj._shared_tokens(sets, 80).collect()
    assert sorted(bytes(r.digest) for r in found) == [bytes([1]), bytes([2])]
    assert all(r.tokens == [1, 2, 3, 4, 5, 6, 7] for r in found)
