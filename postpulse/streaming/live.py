"""A board's signal the moment the board is complete, from a stream of postings in any order.

Rows of a board come over many micro-batches; a keyed state holds its counts
(a few numbers, never its postings) until as many rows have come as the board
says it has.  A timer gives up on boards that never end and reports what was
read as incomplete.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postpulse.operators import signals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = (
    "open_postings", "postings_dated", "opened_7d", "opened_30d", "opened_90d", "opened_prior",
)
STATE = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("oldest_posting_at", "newest_posting_at")]
    + [T.StructField("expected", T.LongType())]
)


def out_schema(keys: tuple[str, ...]) -> T.StructType:
    named = [T.StructField(k, T.StringType()) for k in keys]
    return T.StructType([*named, *STATE.fields, T.StructField("complete", T.BooleanType())])


def windows(posted: pd.Series, as_of: datetime) -> dict[str, int]:
    """The counts of ``signals.company_signal`` over some postings."""

    def within(start: int, end: int = 0) -> int:
        inside = (posted > as_of - timedelta(days=start)) & (posted <= as_of - timedelta(days=end))
        return int(inside.sum())

    return {
        "open_postings": len(posted),
        "postings_dated": int(posted.notna().sum()),
        "opened_7d": within(7),
        "opened_30d": within(30),
        "opened_90d": within(90),
        "opened_prior": within(90, 30),
    }


def _least(a: datetime | None, b: datetime | None, pick=min) -> datetime | None:
    both = [x for x in (a, b) if x is not None]
    return pick(both) if both else None


class BoardCounts(StatefulProcessor):
    """Counts of a board until it is complete; ``give_up_ms`` after its first row it is given up."""

    def __init__(self, keys: tuple[str, ...], as_of: str, give_up_ms: int):
        self.keys, self.as_of, self.give_up_ms = keys, datetime.fromisoformat(as_of), give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = STATE.names
        held = dict(zip(names, self.counts.get(), strict=True)) if self.counts.exists() else None
        if held is None:
            held = dict.fromkeys(names)
            held |= dict.fromkeys(COUNTS, 0)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.give_up_ms)
        for frame in rows:
            posted = pd.to_datetime(frame["posted_at"])
            for name, n in windows(posted, self.as_of).items():
                held[name] += n
            dated = posted.dropna()
            if len(dated):
                held["oldest_posting_at"] = _least(held["oldest_posting_at"], dated.min().to_pydatetime())
                held["newest_posting_at"] = _least(held["newest_posting_at"], dated.max().to_pydatetime(), max)
            expected = frame["expected"].dropna()
            if len(expected):
                held["expected"] = max(held["expected"] or 0, int(expected.max()))
        if held["expected"] is not None and held["open_postings"] >= held["expected"]:
            yield self._row(key, held, True)
            self._forget()
        else:
            self.counts.update(tuple(held.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self._row(key, dict(zip(STATE.names, self.counts.get(), strict=True)), False)
            self._forget()

    def _row(self, key, held: dict, complete: bool) -> pd.DataFrame:
        row = dict(zip(self.keys, key, strict=True)) | held | {"complete": complete}
        frame = pd.DataFrame([row])
        for name in ("oldest_posting_at", "newest_posting_at"):
            frame[name] = pd.to_datetime(frame[name])
        frame["expected"] = frame["expected"].astype("Int64")
        return frame

    def _forget(self) -> None:
        self.counts.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def live_signals(
    stream: DataFrame,
    as_of: str,
    give_up: timedelta = timedelta(hours=1),
    keys: tuple[str, ...] = signals.KEYS,
) -> DataFrame:
    """``signals.company_signal`` of each board of a stream, with ``expected`` and ``complete``.

    ``stream`` has the keys, ``posted_at`` and ``expected``, the number of rows
    that the board has (null where a row does not know it; a board that is read
    and empty sends nothing).  A board is one row of the result as soon as that
    many rows have come, or ``give_up`` after its first row with ``complete``
    false.  Rows of a board behind its last are a new reading of it.  Needs the
    RocksDB state store (``ROCKS``).
    """
    rows = stream.select(*keys, "posted_at", "expected")
    counts = rows.groupBy(*keys).transformWithStateInPandas(
        BoardCounts(keys, as_of, int(give_up.total_seconds() * 1000)),
        outputStructType=out_schema(keys),
        outputMode="append",
        timeMode="processingTime",
    )
    return signals.labelled(counts, as_of, keys, ("expected", "complete"))
