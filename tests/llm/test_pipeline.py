"""The pipeline's stages, each against what its predecessor left."""

from collections import Counter

import corpus_pipeline
import pytest
import __spark_entry__ as entry
from pyspark.sql import functions as F
from tidewheel.llm.common import table, written
from tidewheel.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage of documents with odd ones among them."""
    docs = table(spark, SF_DIR, "documents")
    passage = table(spark, SF_DIR, "benchmark").orderBy("item_id").first()["text"]
    clean = docs.orderBy(F.desc("n_chars")).first()["text"][:900]
    odd = [
        (9001, None, None, None, None),
        (9002, "", "en", "s", 0),
        (None, " ".join(f"w{i} the" for i in range(40)), None, None, 5),
        (9003, clean, "en", "new", 1),
        (9004, clean.upper(), "en", "new", 1),
        (9005, clean[:700] + " " + passage, "en", "new", 1),
    ]
    # A leak in a text of its own, which only the fourth stage has a reason to drop.
    other = docs.where("lang = 'en'").orderBy(F.desc("n_chars")).offset(3).first()["text"]
    odd.append((9006, f"{other[2000:3500]} {passage} {other[5000:6500]}", "en", "own", 1))
    odd.append((9007, f"{other[7000:8500]} {other[3500:5000]}", "en", "own", 1))
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clashing = ["id", "key", "text_key", "kept", "n_words", "script", "a.b", "_row", "root"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in clashing})
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        found.append(docs.collect())
    return found


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_each_stage_leaves_documents_of_the_one_before(stages):
    for before, after in zip(stages[:-1], stages[1:-1]):
        assert ids(after) <= ids(before)
        assert list(after[0].asDict()) == list(before[0].asDict())
        assert all(r["key"] == "own key" and r["a.b"] == "own a.b" for r in after)
    assert set(ids(stages[-1])) == set(ids(stages[-2]))


def test_decisions_take_effect(stages, spark):
    quality, lines, near, leaks = (set(ids(rows)) for rows in stages[1:5])
    assert not {9001, 9002} & quality
    assert 9003 in quality and len(quality) > 0.6 * len(ids(stages[0]))
    assert len(lines) > 0.95 * len(quality)
    assert len(near & {9003, 9004}) <= 1
    assert {9006, 9007} <= near
    assert leaks & {9005, 9006, 9007} == {9007}


def test_registered_and_named():
    queries = entry.queries()
    assert [n for n in queries if n.startswith("op")] == list(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert queries["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
