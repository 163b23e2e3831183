"""Repeated postings of one board: removal, accounting, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions.text import normal_place, normal_title, round_half_up


def keyed(rows: DataFrame, board: str = "board") -> DataFrame:
    """``rows`` with norm_title and norm_place; the empty string means unstated."""
    return rows.withColumns(
        {"norm_title": normal_title("title"), "norm_place": normal_place("location")}
    )


def dedupe_rows(
    rows: DataFrame, board: str = "board", position: str = "pos", apply: bool = True
) -> DataFrame:
    """First copy of each (board, title, place), with duplicates_merged on survivors.

    A row without a title or a stated place never merges.  With ``apply``
    false all rows stay and copy_number tells the copies apart.
    """
    found = keyed(rows)
    mergeable = (F.col("norm_title") != "") & (F.col("norm_place") != "")
    # Rows that never merge have a key of their own, so they form no hot group.
    found = found.withColumn("_alone", F.when(~mergeable, F.monotonically_increasing_id()))
    keys = [board, "norm_title", "norm_place", "_alone"]
    if apply:
        # Copies go before they are shuffled: a partial aggregation keeps the first of each.
        first = F.min_by(F.struct(*rows.columns), position)
        kept = found.groupBy(*keys).agg(first.alias("_row"), (F.count("*") - 1).alias("duplicates_merged"))
        own = [F.col(f"_row.{c}").alias(c) for c in rows.columns]
        return kept.select(*own, "norm_title", "norm_place", F.lit(1).alias("copy_number"), "duplicates_merged")
    copies = Window.partitionBy(*keys)
    return found.withColumns(
        {
            "copy_number": F.row_number().over(copies.orderBy(position)),
            "duplicates_merged": F.count("*").over(copies) - 1,
        }
    ).drop("_alone")


def repeats_by_title(rows: DataFrame, board: str = "board") -> DataFrame:
    """For each board and repeated title, its copies split by what their places say.

    same_location: copies beyond the first at a stated place; distinct_location:
    stated places beyond the first; unstated: copies without a place (all but
    one if no copy states any).  The three add up to the copies beyond the first.
    """
    per_place = (
        keyed(rows)
        .where(F.col("norm_title") != "")
        .groupBy(board, "norm_title", "norm_place")
        .agg(F.count("*").alias("n"))
    )
    stated = F.col("norm_place") != ""
    per_title = per_place.groupBy(board, "norm_title").agg(
        F.sum("n").alias("copies"),
        F.coalesce(F.sum(F.when(stated, F.col("n"))), F.lit(0)).alias("stated"),
        F.count_if(stated).alias("places"),
    )
    blank = F.col("copies") - F.col("stated")
    return per_title.where("copies > 1").select(
        board,
        "norm_title",
        "copies",
        (F.col("copies") - 1).alias("extra"),
        (F.col("stated") - F.col("places")).alias("same_location"),
        F.greatest(F.col("places") - 1, F.lit(0)).alias("distinct_location"),
        F.when(F.col("places") > 0, blank)
        .otherwise(F.greatest(blank - 1, F.lit(0)))
        .alias("unstated"),
    )


def analyse_boards(rows: DataFrame, board: str = "board") -> DataFrame:
    """Repeat accounting of each board that has any postings with a title."""
    totals = keyed(rows).where(F.col("norm_title") != "").groupBy(board)
    totals = totals.agg(F.count("*").alias("postings"))
    repeats = (
        repeats_by_title(rows, board)
        .groupBy(F.col(board).alias("_of"))
        .agg(
            F.count("*").alias("repeated_titles"),
            F.sum("extra").alias("repeated_extra"),
            F.sum("same_location").alias("same_location_extra"),
            F.sum("distinct_location").alias("distinct_location_extra"),
            F.sum("unstated").alias("unstated_extra"),
        )
    )
    names = [
        "repeated_titles",
        "repeated_extra",
        "same_location_extra",
        "distinct_location_extra",
        "unstated_extra",
    ]
    joined = totals.join(repeats, F.col(board) == F.col("_of"), "left")
    return joined.select(
        board, "postings", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def repeat_totals(rows: DataFrame, limit: int, board: str = "board") -> DataFrame:
    """One row about the ``limit`` boards with most repeats: sums, and rates over their postings."""
    worst = rank_by_repeats(rows, limit, board).select(F.col(board).alias("_b"))
    found = analyse_boards(rows.join(worst, F.col(board) == F.col("_b"), "left_semi"), board)
    names = [c for c in found.columns if c != board]
    sums = found.agg(F.count("*").alias("boards"), *[F.sum(n).alias(n) for n in names])
    parts = ("repeated", "same_location", "distinct_location", "unstated")
    rates = {
        f"{n}_rate": round_half_up(F.try_divide(F.col(f"{n}_extra"), F.col("postings")), 4)
        for n in parts
    }
    return sums.withColumns(rates)


def rank_by_repeats(rows: DataFrame, limit: int, board: str = "board") -> DataFrame:
    """The boards with most postings beyond one for each title; ties by name."""
    extra = F.count("*") - F.count_distinct("norm_title")
    ranked = keyed(rows).where(F.col("norm_title") != "").groupBy(board)
    ranked = ranked.agg(F.count("*").alias("postings"), extra.alias("repeats"))
    return ranked.where("repeats > 0").orderBy(F.desc("repeats"), board).limit(limit)
