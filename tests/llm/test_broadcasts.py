"""Sides of joins are broadcast by their bytes as well as by their rows."""

from pyspark.sql import functions as F
from tidewheel.llm import jaccard_join, line_dedup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_members_with_long_ids_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 1000, raising=False)
    rows = spark.range(50).select(F.repeat(F.lit("x"), 100).alias("need"), F.col("id").alias("at"))
    assert "broadcast" not in plan(spark.range(9).join(jaccard_join._small(rows), F.col("id") == F.col("at")))
    assert "broadcast" in plan(spark.range(9).join(jaccard_join._small(rows.limit(5)), F.col("id") == F.col("at")))
    none = rows.select(F.lit(None).cast("string").alias("need"), "at")
    assert "broadcast" in plan(spark.range(9).join(jaccard_join._small(none), F.col("id") == F.col("at")))


def test_long_lines_are_not_broadcast(spark, monkeypatch):
    menu = "a long line " * 200
    docs = spark.createDataFrame([("h", f"{menu}\nown {i}") for i in range(20)], "host string, text string")
    for most, way in ((10_000, True), (1_000, False)):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most, raising=False)
        clean = line_dedup.drop_boilerplate(docs, F.col("host"), F.col("text"))
        assert ("broadcast" in plan(clean)) is way
        assert sorted(r["clean_text"] for r in clean.collect()) == sorted(f"own {i}" for i in range(20))


def test_whole_sets_do_not_shuffle_to_meet_few_keys(spark, monkeypatch):
    """Nor do they lose a link where the keys are too many to be broadcast."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:40], f"x{i}", *words[41:]])) for i in range(3)]
    rows += [(9, " ".join(f"y{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plans, written = {}, jaccard_join.written

    def noted(df, label):
        plans.setdefault(label, []).append(plan(df))
        return written(df, label)

    monkeypatch.setattr(jaccard_join, "written", noted)
    for most, way in ((jaccard_join.BROADCAST_BYTES, True), (-1, False)):
        monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", most)
        plans.clear()
        found = jaccard_join.near_duplicates(docs).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 0, 2: 0, 9: 9}
        for label in ("maybe-links", "block-sets"):
            assert all(("broadcast" in p) is way for p in plans[label])
