"""Operator 7: sources mixed to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import materialized, picked, unused_name

#: Weights by the source's place in code-point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: A source may take each of its words this often.
MAX_COPIES = 3
#: Words left to the exact fit after proportional and greedy filling.
EXACT_WORDS = 4096
#: Slices of a (source, length) group, so that choosing in a hot one is spread.
SLICES = 256


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """``totals`` (key, source, source_size) with each source's target.

    Shares by weight are cut at ``max_copies`` times a source's size and the
    excess shared again; the end of that is one level: a target is weight x
    level or the cut.  Ordered by cut per weight, sources are cut up to the
    first whose cut reaches the level that the rest would get.  One row for
    each source, so the ordering is over sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")
    ).cast("double")
    rows = totals.withColumn("weight", weight).withColumn(
        "cut", max_copies * F.col("source_size").cast("double")
    )
    by_cut = Window.orderBy(F.col("cut") / F.col("weight"), "key")
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    every = by_cut.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    words = F.sum("source_size").over(every) - F.coalesce(F.sum("cut").over(before), zero)
    rows = rows.withColumn("level_here", words / rest)
    reached = F.col("cut") / F.col("weight") >= F.col("level_here")
    rows = rows.withColumn("n_here", F.row_number().over(by_cut))
    level = F.min(F.when(reached, F.struct("n_here", "level_here"))).over(every)
    return rows.withColumn("level", level["level_here"]).withColumn(
        "target", F.coalesce(F.least("cut", F.col("weight") * F.col("level")), "cut")
    )


def fit_budget(
    lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS
) -> np.ndarray:
    """How many documents of each length to take so that their words sum to ``budget``.

    Every length first gives its proportional part, then the longest give
    while ``exact`` words stay open; a bounded knapsack over the rest finds the
    largest sum within the budget.
    """
    takes = np.zeros(len(lengths), dtype=np.int64)
    usable = lengths > 0
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return takes
    share = min(1.0, budget / total)
    takes[usable] = np.minimum(np.floor(counts[usable] * share), counts[usable])
    left = budget - int((takes * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for k in order.tolist():
        size = int(lengths[k])
        if size and left - exact >= size:
            more = min(int(counts[k] - takes[k]), (left - exact) // size)
            takes[k] += more
            left -= more * size
    # Bit s of ``sums`` says that some choice so far adds up to s words.
    steps: list[tuple[int, int, int]] = []
    sums, mask = 1, (1 << (left + 1)) - 1
    for k in order[::-1].tolist():
        size, spare = int(lengths[k]), int(counts[k] - takes[k])
        if not 0 < size <= left:
            continue
        spare, part = min(spare, left // size), 1
        while spare and not sums >> left & 1:
            part = min(part, spare)
            steps.append((k, part, sums))
            sums |= (sums << part * size) & mask
            spare, part = spare - part, part * 2
        if sums >> left & 1:
            break
    reached = sums.bit_length() - 1
    for k, part, earlier in reversed(steps):
        if not earlier >> reached & 1:
            takes[k] += part
            reached -= part * int(lengths[k])
    return takes


def _place(
    seed: int, id_col: F.Column, source_col: F.Column, text_col: F.Column
) -> dict[str, F.Column]:
    """What decides about a row: its source's key, size, seeded order and slice."""
    order = F.xxhash64(F.lit(seed), id_col, text_col)
    return {
        "key": F.coalesce(F.concat(F.lit("="), source_col.cast("string")), F.lit("null")),
        "size": word_count(text_col),
        "order": order,
        "slice": F.pmod(F.shiftright(order, 20), F.lit(SLICES)).cast("int"),
    }


def _quotas(docs: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """q_key, q_size, q_slice, source_size, target, copies and quota of each slice of ``docs``.

    ``docs`` has key, source, size and slice.  All documents of a slice are
    taken ``copies`` times and the first ``quota`` of them once more.
    """
    slices = docs.groupBy("key", "source", "size", "slice").agg(F.count("*").alias("n"))
    slices = materialized(slices, "slices")
    totals = slices.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    goals = targets(totals, weights, max_copies).select(
        F.col("key").alias("of"), "source_size", "target"
    )
    lengths = slices.groupBy("key", "size").agg(F.sum("n").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        words, budget = int(pdf["source_size"][0]), int(round(pdf["target"][0]))
        whole = min(max_copies, budget // words) if words else 0
        rest = budget - whole * words if whole < max_copies else 0
        pdf["copies"] = whole
        pdf["extra"] = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest)
        return pdf[["key", "size", "source_size", "target", "copies", "extra"]]

    plans = (
        lengths.join(goals, F.col("key") == F.col("of"))
        .select("key", "size", "n", "source_size", "target")
        .groupBy("key")
        .applyInPandas(
            plan, "key string, size long, source_size long, target double, copies long, extra long"
        )
        .toDF("p_key", "p_size", "source_size", "target", "copies", "extra")
    )
    earlier = (
        Window.partitionBy("key", "size")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    quota = F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before")))
    return (
        slices.withColumn("before", before)
        .join(plans, (F.col("key") == F.col("p_key")) & (F.col("size") == F.col("p_size")))
        .select(
            F.col("key").alias("q_key"),
            F.col("size").alias("q_size"),
            F.col("slice").alias("q_slice"),
            "source_size",
            "target",
            "copies",
            quota.alias("quota"),
        )
    )


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``df``.

    A source whose budget is b times its words gives all its documents
    floor(b) times; the rest of its budget is fitted on the histogram of its
    document lengths, and within a length seeded hashes of id and text choose.
    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own; null and repeated ids are rows like any other, each
    counted by itself; an empty table gives no rows; other columns are
    ignored.  Documents meet their source's figures on (source, length,
    slice), so no source is one task's burden.
    """
    rows = picked(df, doc_id=id_col, source=source_col, text=text_col)
    place = _place(seed, F.col("doc_id"), F.col("source"), F.col("text"))
    docs = materialized(rows.withColumns(place).drop("text"), "sizes")
    quotas = _quotas(docs, weights, max_copies)
    ranked = docs.withColumn(
        "n_here",
        F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("order", "doc_id")),
    )
    same = (
        (F.col("key") == F.col("q_key"))
        & (F.col("size") == F.col("q_size"))
        & (F.col("slice") == F.col("q_slice"))
    )
    times = F.col("copies") + (F.col("n_here") <= F.col("quota")).cast("long")
    return ranked.join(quotas, same).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * times).alias("taken"),
    )


def copies(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``df`` with all their columns, each as often as ``mix`` takes it.

    Rows are taken one by one, whether or not they share an id; columns may
    have any names.
    """
    place = _place(seed, df[id_col], df[source_col], df[text_col])
    docs = df.select(*[c.alias(n) for n, c in place.items()], df[source_col].alias("source"))
    quotas = _quotas(docs, weights, max_copies)
    own = {n: unused_name(df, n) for n in (*place, "n_here", "times")}
    wanted = {n: unused_name(df, n) for n in ("q_key", "q_size", "q_slice", "copies", "quota")}
    quotas = quotas.select(*[F.col(n).alias(new) for n, new in wanted.items()])
    rows = df.withColumns({own[n]: c for n, c in place.items()})
    first = Window.partitionBy(own["key"], own["size"], own["slice"]).orderBy(own["order"], id_col)
    rows = rows.withColumn(own["n_here"], F.row_number().over(first))
    same = (
        (F.col(own["key"]) == F.col(wanted["q_key"]))
        & (F.col(own["size"]) == F.col(wanted["q_size"]))
        & (F.col(own["slice"]) == F.col(wanted["q_slice"]))
    )
    times = F.col(wanted["copies"]) + (F.col(own["n_here"]) <= F.col(wanted["quota"])).cast("long")
    taken = rows.join(quotas, same).where((F.col(own["size"]) > 0) & (times > 0))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(own["times"])
    return taken.select(*df.columns, copy).drop(own["times"])
