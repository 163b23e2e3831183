"""Repeated readings of outside figures: counters, presence, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_changes(readings: DataFrame, name: str = "name", at: str = "read_at") -> DataFrame:
    """Each counter's change since its reading before; null at its first."""
    order = Window.partitionBy(name).orderBy(at)
    before = F.lag("value").over(order)
    return readings.withColumns({"previous": before, "change": F.col("value") - before})


def presence_changes(
    readings: DataFrame, controls: DataFrame, name: str = "name", at: str = "read_at"
) -> DataFrame:
    """Readings that differ from the one before, among those that count as evidence.

    ``controls`` has the time of each probe and whether a known entry was
    found.  An absence is evidence only if every control of that probe was
    found; a presence always is.
    """
    passed = controls.groupBy(F.col(at).alias("_at")).agg(F.min("found").alias("controls_ok"))
    joined = readings.join(passed, F.col(at) == F.col("_at"), "left").drop("_at")
    evidence = F.col("present") | F.coalesce("controls_ok", F.lit(False))
    order = Window.partitionBy(name).orderBy(at)
    before = F.lag("present").over(order)
    rows = joined.where(evidence).withColumn("was_present", before)
    return rows.where(F.col("was_present").isNotNull() & (F.col("present") != F.col("was_present")))


def current_record(history: Column) -> Column:
    """The last record of an append-only history; null if it is empty."""
    return F.try_element_at(history, F.lit(-1))


def free_prices(events: Column) -> Column:
    """Price by event of a map of (tiered, flat) structs: the free tier's, else the flat one."""
    return F.transform_values(events, lambda _, e: F.coalesce(e["free"], e["flat"]))


def audit_queue(hits: DataFrame, cached: DataFrame, most: int = 12) -> DataFrame:
    """What to read for a key audit: all cached boards, and of the others ``most`` a key.

    Of a key's other boards the first by ``pos`` are taken; ``place`` is a
    board's turn within its key: larger boards come first, then by name.
    """
    known = cached.select(F.col("board").alias("_b")).distinct().withColumn("cached", F.lit(True))
    joined = hits.join(known, F.col("board") == F.col("_b"), "left").drop("_b")
    joined = joined.withColumn("cached", F.coalesce("cached", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("key", "cached").orderBy("pos"))
    rows = joined.withColumn("place", place)
    rows = rows.where(F.col("cached") | (F.col("place") <= most))
    turn = Window.partitionBy("key").orderBy(F.desc("postings"), "board")
    return rows.withColumn("place", F.row_number().over(turn))
