"""Exact dedup against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import exact_dedup


def plain(rows):
    """One tuple a row; of rows with one id and text, all but one are not kept."""
    groups = defaultdict(list)
    for name, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(name)
    found = []
    for text, names in groups.items():
        names.sort(key=lambda x: (x is None, x or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(n, names[0], len(names), i == 0, digest) for i, n in enumerate(names)]
    return sorted(found, key=repr)


def result(docs):
    rows = exact_dedup.exact_duplicates(docs)
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i * 7 % 1000 + (1 << 60), "hot\t copy") for i in range(400)]
    out += [(i, f"text  {i % 90}\n{'x' * (i % 3)}") for i in range(400)]
    out += [(i, f"text\x0b {i % 90} {'x' * (i % 3)}") for i in range(400, 500)]
    out += [(600, None), (601, ""), (602, " "), (603, "\r\n"), (604, "\x1c"), (605, "  ")]
    out += [(None, "no id"), (None, "no id"), (None, "hot copy"), (700, "no  id")]
    out += [(800, "same row"), (800, "same row"), (None, "alone"), (None, "alone")]
    out += [(900, "long " * 400_000), (901, "long\n" * 400_000), (902, "long " * 399_999)]
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_equals_plain(spark, rows, parts):
    wide = [(i, t, 1, "r", "s") for i, t in rows]
    schema = "doc_id bigint, text string, row int, run string, `least` string"
    docs = spark.createDataFrame(wide, schema).repartition(parts)
    assert result(docs) == plain(rows)


def test_many_rounds(spark, rows, monkeypatch):
    """300 runs take three rounds of sixteen ways; a hot text is in every run."""
    few = [(i, f"t {i % 5}") for i in range(600)]
    docs = spark.createDataFrame(few, "doc_id int, text string").repartition(300)
    assert result(docs) == plain(few)


def test_digests_that_agree_by_chance_stay_apart(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20)
    digested = exact_dedup.digests(docs, "doc_id", "text").withColumn("short", F.lit(5).cast("bigint"))
    groups = exact_dedup.exact_groups(digested).groupBy("sha").agg(
        F.count("*").alias("rows"), F.max("n").alias("n"), F.countDistinct("least").alias("one")
    )
    for row in groups.collect():
        assert row.rows == row.n and row.one == 1


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    kept = exact_dedup.exact_duplicates(docs).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == ["a", "c"]
    assert result(docs.limit(0)) == []


def test_no_python_in_the_plan(spark, rows, capsys):
    docs = spark.createDataFrame(rows[:50], "doc_id bigint, text string")
    exact_dedup.exact_duplicates(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
