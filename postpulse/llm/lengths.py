"""Operator 2: token counts from an exact length histogram."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import materialized
from postpulse.llm.tokens import token_counts

#: Lengths that share a block of the running sums.
BLOCK = 1024


def histogram(df: DataFrame, **options) -> DataFrame:
    """length and n_docs: how many documents encode to each number of tokens.

    Counts are added up before the shuffle, so what moves is bounded by the
    distinct lengths of a task's documents.  Null texts have length 0, repeated
    rows count each, texts of any length are taken whole, other columns are
    ignored, and an empty table gives no rows.
    """
    counts = token_counts(df, **options)
    return counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def cumulative(lengths: DataFrame) -> DataFrame:
    """The histogram with its suffix sums: what every context limit needs.

    For a limit equal to ``length``: docs_over and tokens_over count longer
    documents and their tokens, docs_up_to those that fit, truncated_tokens
    the corpus cut to the limit, and kept_share its part of all tokens;
    quantile is the share of documents that fit.  Between two lengths
    docs_over and tokens_over are those of the lower one, so any limit has an
    exact answer (``at_limits``).  An empty histogram gives no rows; lengths
    come once each and are not null, as ``histogram`` gives them, and other
    columns are ignored.

    Sums run within blocks of ``BLOCK`` lengths and over the blocks' totals,
    which leaves one row for each block to the only global ordering.
    """
    rows = materialized(lengths, "lengths").withColumns(
        {"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("n_docs")}
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    later = totals.select(
        F.col("block").alias("of"),
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    within = (
        Window.partitionBy("block")
        .orderBy(F.desc("length"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    docs_over = F.col("later_docs") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))
    tokens_over = F.col("later_tokens") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    cut = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return (
        rows.join(later, F.col("block") == F.col("of"))
        .withColumns({"docs_over": docs_over, "tokens_over": tokens_over})
        .select(
            "length",
            "n_docs",
            (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"),
            "docs_over",
            "tokens_over",
            cut.alias("truncated_tokens"),
            F.try_divide(cut.cast("double"), F.col("all_tokens")).alias("kept_share"),
            ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limits(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """limit, docs_over and truncated_tokens for any context limits, known lengths or not.

    One aggregate over the histogram: for each limit, the last length within it.
    """
    limits = [int(x) for x in limits]
    within = [
        F.max_by(
            F.struct("docs_over", "tokens_over"), F.when(F.col("length") <= x, F.col("length"))
        ).alias(f"w{k}")
        for k, x in enumerate(limits)
    ]
    every = [F.max("truncated_tokens").alias("tokens"), F.sum("n_docs").alias("docs")]
    answers = []
    for k, x in enumerate(limits):
        over = F.coalesce(F.col(f"w{k}.docs_over"), F.col("docs"))
        past = F.coalesce(F.col(f"w{k}.tokens_over"), F.col("tokens"))
        answers.append(
            F.struct(
                F.lit(x).cast("long").alias("limit"),
                over.alias("docs_over"),
                (F.col("tokens") - past + over * x).alias("truncated_tokens"),
            )
        )
    return sums.agg(*every, *within).select(F.inline(F.array(*answers)))


def quantile_length(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """share and the smallest length that at least that share of documents fit."""
    shares = list(shares)
    picks = [
        F.min(F.when(F.col("quantile") >= s, F.col("length"))).alias(f"q{k}")
        for k, s in enumerate(shares)
    ]
    pairs = [
        F.struct(F.lit(s).alias("share"), F.col(f"q{k}").alias("length"))
        for k, s in enumerate(shares)
    ]
    return sums.agg(*picks).select(F.inline(F.array(*pairs)))
