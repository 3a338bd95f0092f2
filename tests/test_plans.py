"""What the plans must look like to hold up on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scoring as sc
from tidewheel.operators import correlation as co
from tidewheel.operators import counters as ct
from tidewheel.operators import metrics as mt
from tidewheel.operators import training as tr
from tidewheel.plans import tables as tb
from tidewheel.plans.queries import QUERIES
from tidewheel.session import scratch_path
from tidewheel.streaming import scoring as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan(df)))


def test_training_reads_few_columns_and_shuffles_partial_sums(spark, sf_dir):
    lines = tb.table(spark, sf_dir, "lineitem")
    rows = tr.labelled_rows(lines, "l_returnflag", tb.LINE_CODES)
    moments = tr.class_moments(rows, tb.LINE_FEATURES)
    text = plan(moments)
    assert exchanges(moments) == 1
    assert "partial_var_pop" in text
    assert "In(l_returnflag, [A,R])" in text
    assert "l_orderkey" not in text


@pytest.mark.parametrize("form", ["expression", "batch"])
def test_scoring_is_map_only(spark, sf_dir, form):
    m = tb.line_model(spark, sf_dir)
    scored = sc.nb_predict_batch(
        tb.table(spark, sf_dir, "lineitem"), tb.LINE_FEATURES, m, form
    ).select("positive")
    text = plan(scored)
    assert exchanges(scored) == 0 and "Join" not in text
    assert ("ArrowEvalPython" in text) == (form == "batch")
    assert "l_orderkey" not in text


def test_messages_are_parsed_once(spark, sf_dir):
    messages = tb.line_messages(tb.table(spark, sf_dir, "lineitem"))
    m = tb.line_model(spark, sf_dir)
    results = st.result_messages(st.score_messages(messages, m), name="parsed_once")
    assert exchanges(results) == 0
    assert optimized(results).count("from_json") == 1


def test_matching_keys_by_slot_and_acts_on_nothing(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    sides = tb.requests(events), tb.replies(events)
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup(None)
    roundtrip, matches = co.reply_roundtrip(*sides), co.reply_match(*sides)
    assert tracker.getJobIdsForGroup(None) == before
    # One shuffle merges replies of one instant, one brings both sides together.
    assert exchanges(roundtrip) == 2 and "Join" not in plan(roundtrip)
    assert "slot" in re.search(r"Window .*", plan(roundtrip)).group()
    assert "asked_slot" in plan(matches) and "NestedLoop" not in plan(matches)


def test_backlog_joins_distinct_ids(spark, sf_dir):
    events = tb.table(spark, sf_dir, "events")
    text = plan(co.topic_backlog(tb.requests(events), tb.replies(events), F.to_date("ts")))
    assert "LeftAnti" in text and "Cartesian" not in text


def test_metrics_add_up_below_one_shuffle(spark, sf_dir):
    latest = mt.metric_latest(tb.samples(tb.table(spark, sf_dir, "events")), "view")
    text = plan(latest)
    assert exchanges(latest) == 1 and "partial_max" in text
    assert "EqualTo(event_type,view)" in text


def test_visit_numbers_need_no_window_over_a_page_s_rows(spark, sf_dir):
    visits = tb.visits(tb.table(spark, sf_dir, "events"))
    numbered = ct.visit_number(visits, scratch_path(spark, "n"), order=("ts", "event_id"))
    text = plan(numbered)
    assert text.count("Window") == 1 and "row_number" not in text and "NestedLoop" not in text


def test_a_model_is_trained_once(spark, sf_dir):
    record = tb.line_model_record(spark, sf_dir)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = record.mapInArrow(count, record.schema)
    sc.load_model(counted)
    assert seen.value == 1
    with pytest.raises(ValueError, match="allowed are 1 to 7"):
        sc.load_model(record, max_terms=7)


@pytest.mark.parametrize(
    "name",
    sorted(n for n in QUERIES if not re.search("stream|topic_s|resume|visit_count", n)),
)
def test_no_query_multiplies_its_tables(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
