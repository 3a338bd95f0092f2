"""Rows without an id are told apart even if a hash of 32 bits is not enough."""

from pyspark.sql import functions as F
from tidewheel.llm import substring_dedup as sd
from tidewheel.llm.pruning import KeyFilter

STRETCH = " ".join(f"w{i}" for i in range(29))


def test_texts_of_equal_short_hash(spark):
    texts = spark.range(300_000).select(F.concat(F.lit("k"), "id", F.lit(" " + STRETCH)).alias("text"))
    pair = (
        texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1)
    ).first()["t"][:2]
    docs = spark.createDataFrame([(None, t) for t in pair], "doc_id bigint, text string")
    found = sd.without_repeats(docs).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 29]


def test_large_ids_beside_null_ids(spark):
    """Numbers a double cannot hold, next to a null."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} a b", f"x {passage} {passage}", f"y z {passage}", f"{passage} {passage}"]
    big = 1 << 60
    small_ids, large_ids = [1, 3, None, 4], [big + 1, big + 3, None, big + 4]

    def removed(ids, kind="bigint"):
        rows = list(zip(ids, texts))
        docs = spark.createDataFrame(rows * 2, f"doc_id {kind}, text string").repartition(3)
        found = sd.without_repeats(docs).collect()
        assert len(found) == 8
        return sorted((ids.index(r["doc_id"]), r["n_removed"], r["kept_text"]) for r in found)

    assert removed(small_ids) == removed(large_ids)
    assert removed(["a", "b", None, "d"], "string") == removed(small_ids)


def test_filter_of_any_size_loses_nothing(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"s{i} {passage} e{i} " + " ".join(f"q{i}{j}" for j in range(30))) for i in range(50)]
    rows += [(i, f"alone{i} " * 3) for i in range(50, 90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)

    def kept():
        return sorted((r["doc_id"], r["kept_text"]) for r in sd.without_repeats(docs).collect())

    fitting = kept()
    monkeypatch.setattr(KeyFilter.__init__, "__defaults__", (1,))
    assert kept() == fitting
    assert sum(len(t.split()) for _, t in fitting) == 50 * 32 + 40 + 40 * 3


def test_filter_splits_rows(spark):
    keys = spark.range(2_000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(-1_000, 6_000).select("id", F.xxhash64("id").alias("key"))
    chosen = KeyFilter(keys)
    inside = {r["id"] for r in chosen.split(rows, True).collect()}
    outside = {r["id"] for r in chosen.split(rows, False).collect()}
    assert set(range(2_000)) <= inside and not inside & outside
    assert inside | outside == set(range(-1_000, 6_000))
    assert len(outside) > 4_500
    assert KeyFilter(keys.limit(0)).split(rows, True).count() == 0
