"""Signals against a fixed instant: window bounds, labels, guards."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from postpulse.operators import signals

NOW = datetime(2026, 9, 3)
AS_OF = "2026-09-03"
SCHEMA = "source string, company string, posted_at timestamp_ntz, department string"


def board(spark, ages, department="Ops"):
    rows = [
        ("s", "c", None if a is None else NOW - timedelta(days=a), department) for a in ages
    ]
    return spark.createDataFrame(rows, SCHEMA)


def one(spark, ages):
    return signals.company_signal(board(spark, ages), AS_OF).first()


def test_window_is_open_below_and_closed_above(spark):
    row = one(spark, [0, 7, 30, 90, -1])
    assert (row.opened_7d, row.opened_30d, row.opened_90d) == (1, 2, 3)
    assert row.open_postings == 5


@pytest.mark.parametrize(
    ("ages", "label"),
    [
        ([None, None], "undated"),
        ([1, 59], "new_board"),
        ([1, 2, 3, 100], "ramping"),
        ([1, 2, 100], "steady"),
        ([100, 200], "quiet"),
        ([1, 2, 3, 40, 50, 60, 100], "ramping"),
        ([1, 2, 3, 40, 50, 60, 70, 100], "steady"),
    ],
)
def test_labels(spark, ages, label):
    assert one(spark, ages).signal == label


def test_ratio_is_null_without_a_baseline(spark):
    row = one(spark, [1, 2, 100])
    assert row.ramp_ratio is None and row.baseline_30d == 0


def test_new_functions_need_history_and_skip_places(spark):
    old = board(spark, [100, 101, 102])
    fresh = board(spark, [1, 2], "Legal")
    place = board(spark, [1, 2, 3], "Austin, TX")
    found = signals.new_functions(old.union(fresh).union(place), AS_OF).collect()
    assert [(r.name, r["count"]) for r in found] == [("Legal", 2)]
    assert not signals.new_functions(board(spark, [100, 1]).union(fresh), AS_OF).collect()


def test_top_counts_break_ties_by_name(spark):
    rows = board(spark, [1, 2], "b").union(board(spark, [1, 2], "a")).union(board(spark, [1], ""))
    found = signals.top_counts(rows, "department", 5).orderBy("rank").collect()
    assert [(r.name, r["count"]) for r in found] == [("a", 2), ("b", 2)]


def test_empty_board_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert signals.company_signal(empty, AS_OF).count() == 0


def test_a_record_reads_postings_twice(spark, sf_dir):
    from postpulse.plans import boards

    frame = boards.full_postings(spark, sf_dir)
    plan = signals.signal_records(frame, AS_OF)._jdf.queryExecution().executedPlan().toString()
    own = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 * own.count("FileScan")
