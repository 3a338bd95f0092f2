"""Copies pass the pipeline's line stage whole, so that one of each group stays."""

import random

import corpus_pipeline
import pytest
from corpus_words import sentence
from tidewheel.llm.common import written

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MENU = "read more about us on the page of our house"


def lines_of(rng, n):
    return [" ".join(sentence(rng, 30)) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """A third of the rows are exact copies of one text or copies with a few edits; a
    menu line is on every other page."""
    rng = random.Random(4)
    base = lines_of(rng, 22)
    texts = ["\n".join(base)] * 12
    for k in range(12):
        near = list(base)
        words = near[k].split()
        words[k] = f"edit{k}"
        near[k] = " ".join(words)
        texts.append("\n".join(near))
    texts += ["\n".join([MENU, *lines_of(rng, 6)]) for _ in range(48)]
    rows = [(i, t, "en", "hot", len(t)) for i, t in enumerate(texts)]
    pair = "\n".join(lines_of(rng, 22))
    rows += [(100 + i, pair, "en", "small", len(pair)) for i in range(2)]
    own = ["\n".join(lines_of(rng, 5)) for _ in range(10)]
    return rows + [(200 + i, t, "en", "small", len(t)) for i, t in enumerate(own)]


@pytest.fixture(scope="module")
def after(spark, planted):
    docs = spark.createDataFrame(planted, SCHEMA).repartition(5)
    lines = written(corpus_pipeline.site_lines(spark, docs, ""), "lines")
    near = corpus_pipeline.near_duplicates(spark, lines, "")
    return lines.collect(), near.collect()


def test_copies_pass_the_line_stage_whole(planted, after):
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after[0]}
    assert len(after[0]) == len(planted)
    for doc_id, text, _, _, _ in planted:
        clean = text.replace(MENU + "\n", "")
        assert found[doc_id] == (clean, len(clean))


def test_exactly_one_of_each_group_stays(after):
    ids = [r["doc_id"] for r in after[1]]
    assert len([i for i in ids if i < 24]) == 1
    assert len([i for i in ids if i in (100, 101)]) == 1
    assert len([i for i in ids if i >= 24 and i not in (100, 101)]) == 58
