"""Signals from keyed state, capped pushes and deadlines, each also after a stop or a failure."""

from __future__ import annotations

import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from postpulse.operators import signals
from postpulse.sources import boards, push
from postpulse.streaming import history, live

AS_OF = "2026-01-31 00:00:00"
POSTING = "source string, company string, posted_at timestamp_ntz, expected long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.ROCKS)
    yield spark
    spark.conf.set(name, before)


def dropped(folder, number, rows):
    lines = [json.dumps(dict(zip(("source", "company", "posted_at", "expected"), r, strict=True))) for r in rows]
    (folder / f"{number}.json").write_text("\n".join(lines))


def run(spark, tmp_path, rows, give_up=timedelta(hours=1)):
    """The table after a run that read ``rows`` new rows; timers keep a query awake, so it is stopped."""
    stream = spark.readStream.schema(POSTING).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = live.live_signals(stream, AS_OF, give_up)
    query = (
        found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        end = time.time() + 60
        while time.time() < end:
            seen = [p.numInputRows for p in query.recentProgress]
            if sum(seen) >= rows and seen[-2:] == [0, 0]:
                break
            query.awaitTermination(0.2)
        assert sum(seen) == rows
    finally:
        query.stop()
    return {r.company: r for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}


def test_a_board_is_reported_when_complete(rocks, tmp_path):
    spark = rocks
    (tmp_path / "in").mkdir()
    days = ["2026-01-29", "2026-01-10", "2025-12-20", "2025-11-20", None, "2025-06-01"]
    rows = [("s", "a", d and f"{d} 00:00:00", 6) for d in days]
    dropped(tmp_path / "in", 1, rows[:2] + [("s", "b", None, None), ("s", "small", "2026-01-30 00:00:00", 1)])
    first = run(spark, tmp_path, 4)
    assert set(first) == {"small"} and first["small"].complete
    # The stream was stopped; its state goes on where it was.
    dropped(tmp_path / "in", 2, rows[2:5])
    dropped(tmp_path / "in", 3, rows[5:] + [("s", "b", "2026-01-01 00:00:00", 3)])
    found = run(spark, tmp_path, 5)
    assert set(found) == {"small", "a"}
    whole = signals.company_signal(spark.createDataFrame(rows, "source string, company string, posted_at string, expected long")
                                   .withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz")), AS_OF).first()
    for name in whole.asDict():
        assert found["a"][name] == whole[name], name


def test_a_board_that_never_ends_is_given_up(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    dropped(tmp_path / "in", 1, [("s", "a", "2026-01-29 00:00:00", 9), ("s", "a", None, None)])
    found = run(rocks, tmp_path, 2, timedelta(0))
    assert (found["a"].open_postings, found["a"].expected, found["a"].complete) == (2, 9, False)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    dropped(tmp_path / "in", 1, [("s", "a", "2026-01-29 00:00:00", 1), ("s", "b", None, 1)])
    stream = spark.readStream.schema(POSTING).json(str(tmp_path / "in"))
    for _ in range(2):
        history.signal_stream(stream, AS_OF, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
        # As after a failure between the batch's write and its commit.
        for name in ("0", ".0.crc"):
            (tmp_path / "cp" / "commits" / name).unlink()


ROWS = "k long, s string"


@pytest.mark.parametrize("cap, budget, delivered", [(100, None, 100), (25, None, 25), (100, 30, 30), (0, None, 0), (7, 9, 7)])
def test_a_cap_holds_over_all_tasks(spark, tmp_path, cap, budget, delivered):
    frame = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("é\n"), "id").alias("s")).repartition(7)
    path = str(tmp_path / "out")
    stats = push.push(frame, path, cap, budget, batch_rows=4)
    assert stats["rows_delivered"] == delivered and stats["rows_offered"] == 100
    assert stats["rows_given_back"] == min(cap, 100) - delivered
    assert stats["complete"] == (delivered == 100) and stats["cap_reached"] == (cap < 100)
    found = [tuple(r) for r in push.delivered(spark, path, ROWS).collect()]
    assert len({k for k, _ in found}) == delivered and all(s == f"é\n{k}" for k, s in found)
    assert len(list((tmp_path / "out").glob("batch-*"))) == len(stats["batches"])


def test_a_failed_push_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x")
    frame = spark.range(0, 100, 1, 4).select(F.col("id").alias("k"), bad.cast("string").alias("s"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        push.push(frame, path, 1_000, batch_rows=5)
    with pytest.raises(FileNotFoundError):
        push.delivery(path)
    assert len(list((tmp_path / "out").glob("batch-*"))) == 0 or not (tmp_path / "out" / push.MANIFEST).exists()


def test_nothing_to_push(spark, tmp_path):
    stats = push.push(spark.createDataFrame([], ROWS), str(tmp_path / "out"), 10)
    assert stats["rows_delivered"] == 0 and stats["complete"]
    assert push.delivered(spark, str(tmp_path / "out"), ROWS).collect() == []


def test_a_deadline_ends_a_sweep(spark):
    frame = spark.createDataFrame([("v", f"b{k}") for k in range(20)], "source string, company string")
    endpoints = {"v": "http://127.0.0.1:9/{}"}
    late, seen = boards.with_progress(boards.read_boards(frame, 2, endpoints=endpoints, unit=0.0, until=time.time() - 1))
    assert {r.reason for r in late.collect()} == {"deadline"}
    assert boards.run_stats(seen) == {"units_planned": 20, "units_completed": 0, "units_failed": 0, "complete": False}
    soon = time.time() + 3600
    rows, seen = boards.with_progress(boards.read_boards(frame, 2, endpoints=endpoints, unit=0.0, until=soon))
    assert all(r.body is None and r.reason != "deadline" for r in rows.collect())
    assert boards.run_stats(seen) == {"units_planned": 20, "units_completed": 20, "units_failed": 20, "complete": True}
