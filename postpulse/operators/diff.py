"""Comparing two snapshots; a board that was not read is never an empty one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions.text import round_half_up

KEYS = ("source", "company")

# What counts as a ramp between two days.
RAMP_DELTA, RAMP_SHARE = 5, 0.3


def board_changes(
    previous: DataFrame, current: DataFrame, unread_previous: DataFrame, unread_current: DataFrame
) -> DataFrame:
    """One row for each board of either issue: prev_open, open, delta and class flags.

    Both issues have the keys, open and signal; the unread frames have the
    keys.  One full outer join on the board; appeared and went_quiet hold only
    where the other issue did read the board.
    """
    keys = list(KEYS)
    before = previous.select(
        *keys, F.col("open").alias("prev_open"), F.col("signal").alias("prev_signal")
    )
    joined = before.join(current.select(*keys, "open", "signal"), keys, "full_outer")
    for name, unread in (("unread_before", unread_previous), ("unread_now", unread_current)):
        marked = unread.select(*keys).distinct().withColumn(name, F.lit(True))
        joined = joined.join(marked, keys, "left")
    both = F.col("open").isNotNull() & F.col("prev_open").isNotNull()
    delta = F.col("open") - F.col("prev_open")
    no = F.lit(False)
    ramps, ramped = F.col("signal") == "ramping", F.col("prev_signal") == "ramping"
    flags = {
        "grew": both & (delta > 0),
        "shrank": both & (delta < 0),
        "became_ramping": both & ramps & ~ramped,
        "stopped_ramping": both & ramped & ~ramps,
        "appeared": F.col("prev_open").isNull() & F.col("unread_before").isNull(),
        "went_quiet": F.col("open").isNull() & F.col("unread_now").isNull(),
    }
    return joined.select(
        *keys,
        "prev_open",
        "open",
        delta.alias("delta"),
        *[F.coalesce(flag, no).alias(name) for name, flag in flags.items()],
    )


CLASSES = ("grew", "shrank", "became_ramping", "stopped_ramping", "appeared", "went_quiet")


def change_lists(changes: DataFrame, limit: int = 15) -> DataFrame:
    """The boards of each class, the strongest first, at most ``limit``.

    Growing classes go by rise, shrinking ones by fall, the others by size.
    """
    named = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CLASSES]))
    rows = changes.withColumn("class", F.explode(named))
    falls = F.col("class").isin("shrank", "stopped_ramping")
    strength = F.when(falls, -F.col("delta")).otherwise(F.coalesce("delta", "open", "prev_open"))
    order = Window.partitionBy("class").orderBy(strength.desc(), *KEYS)
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("class", "rank", *KEYS, "prev_open", "open", "delta")


def gross_changes(changes: DataFrame) -> DataFrame:
    """Boards in both issues, gross growth and shrinkage, net change, and class sizes."""
    delta = F.coalesce("delta", F.lit(0))
    return changes.agg(
        F.count("delta").alias("common"),
        F.sum(F.greatest(delta, F.lit(0))).alias("gross_up"),
        F.sum(F.greatest(-delta, F.lit(0))).alias("gross_down"),
        F.sum(delta).alias("net"),
        *[F.count_if(F.col(c)).alias(c) for c in CLASSES],
    )


def technology_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Companies by technology against the issue before; unchanged lines go, new ones stay."""
    before = previous.select("technology", F.col("companies").alias("prev_companies"))
    joined = current.select("technology", "companies").join(before, "technology", "left")
    delta = F.col("companies") - F.col("prev_companies")
    rows = joined.withColumns({"delta": delta, "entered": F.col("prev_companies").isNull()})
    return rows.where(F.col("delta").isNull() | (F.col("delta") != 0))


def list_entries(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Companies that entered or left a ranked table."""
    keys = list(KEYS)
    entered = current.select(*keys).distinct().join(previous.select(*keys), keys, "left_anti")
    left = previous.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")
    return entered.withColumn("change", F.lit("entered")).unionByName(
        left.withColumn("change", F.lit("left"))
    )


def day_signals(before: DataFrame, after: DataFrame, covered_before: DataFrame) -> DataFrame:
    """Day-over-day signals of boards from (source, company, open) snapshots.

    new_board needs the earlier day to have covered the board's source, so a
    gap in coverage is no news; went_dark needs a reading of zero.
    """
    keys = list(KEYS)
    joined = before.select(*keys, F.col("open").alias("was")).join(
        after.select(*keys, F.col("open").alias("now")), keys, "full_outer"
    )
    covered = covered_before.select("source").distinct().withColumn("covered", F.lit(True))
    joined = joined.join(covered, "source", "left")
    delta = F.col("now") - F.col("was")
    large = F.abs(delta) >= RAMP_DELTA
    large &= F.abs(delta) >= F.col("was") * RAMP_SHARE
    signal = (
        F.when(F.col("was").isNull() & F.col("covered") & (F.col("now") > 0), "new_board")
        .when((F.col("was") > 0) & (F.col("now") == 0), "went_dark")
        .when((delta > 0) & large, "ramp_up")
        .when((delta < 0) & large & (F.col("now") > 0), "ramp_down")
    )
    rows = joined.select(*keys, "was", "now", delta.alias("delta"), signal.alias("signal"))
    return rows.where(F.col("signal").isNotNull())


def issue_to_issue(issues: DataFrame) -> DataFrame:
    """Each board's change since the issue before in which it was read."""
    order = Window.partitionBy(*KEYS).orderBy("issue_date")
    return issues.withColumns(
        {
            "prev_issue": F.lag("issue_date").over(order),
            "delta": F.col("open") - F.lag("open").over(order),
        }
    )


#: The ranked tables that two issues are compared by where one has no roster.
TABLES = ("ramping", "new_boards", "new_functions", "executive_openings")


def compared(
    previous: dict[str, DataFrame], current: dict[str, DataFrame], limit: int = 15
) -> tuple[str, DataFrame]:
    """What changed between two issues, and on what basis.

    An issue has its frames by name: roster and unread, and the ranked
    ``TABLES``.  With both rosters the basis is ``roster`` and the rows are
    ``change_lists``; else it is ``top_lists`` and the rows tell for each table
    which companies entered or left it.
    """
    if previous.get("roster") is not None and current.get("roster") is not None:
        none = current["roster"].limit(0)
        changes = board_changes(
            previous["roster"],
            current["roster"],
            previous.get("unread", none),
            current.get("unread", none),
        )
        return "roster", change_lists(changes, limit)
    found = [
        list_entries(previous[name], current[name]).select(F.lit(name).alias("table"), "change", *KEYS)
        for name in TABLES
        if name in previous and name in current
    ]
    return "top_lists", reduce(DataFrame.unionByName, found)


def by_change(signals: DataFrame) -> DataFrame:
    """Day signals with the largest change first, whatever its direction."""
    return signals.orderBy(F.desc(F.abs("delta")), *KEYS)


def hours_between(earlier: Column, later: Column) -> Column:
    """Hours from one instant to another, to one digit."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return round_half_up(seconds / 3.6e9, 1)
