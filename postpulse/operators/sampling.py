"""Stratified samples, ratio estimators and reproducible bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.operators.ranking import with_place

# Strata as (name, least postings, boards to sample; None: census).
STRATA = (
    ("500+", 500, None),
    ("100-499", 100, None),
    ("30-99", 30, 260),
    ("10-29", 10, 240),
    ("3-9", 3, 200),
    ("1-2", 1, 120),
)
# The generator of the bootstrap and its seed.
LCG_A, LCG_C, LCG_M, SEED, DRAWS = 1664525, 1013904223, 1 << 32, 20260903, 2000


def stratum(size: Column, strata=STRATA) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, least, _ in strata:
        found = found.when(size >= least, name)
    return found


def strata_plan(boards: DataFrame, strata=STRATA, size: str = "postings") -> DataFrame:
    """Per stratum: boards, postings, weight in all postings and boards to read."""
    placed = boards.withColumn("stratum", stratum(F.col(size), strata))
    placed = placed.where(F.col("stratum").isNotNull())
    sums = placed.groupBy("stratum").agg(
        F.count("*").alias("boards"), F.sum(size).alias("postings")
    )
    target = F.when(F.lit(False), F.lit(None).cast("long"))
    for name, _, wanted in strata:
        here = F.col("stratum") == name
        target = target.when(here, F.col("boards") if wanted is None else F.lit(wanted))
    census = F.col("stratum").isin(*[n for n, _, wanted in strata if wanted is None])
    return sums.select(
        "stratum",
        census.alias("census"),
        "boards",
        "postings",
        (F.col("postings") / F.sum("postings").over(Window.partitionBy())).alias("weight"),
        F.least("boards", target).alias("target"),
    )


def every_kth(boards: DataFrame, plan: DataFrame, strata=STRATA, size: str = "postings") -> DataFrame:
    """Evenly spaced boards of each stratum, by size: places floor(i x n / target).

    Place p is taken iff some i has floor(i n / t) = p, which a board decides
    from its own place: ceil(p t / n) x n / t must still floor to p.  Strata
    are ranges of size, so a place within one is the place in all less the
    boards of the strata above.
    """
    placed = boards.withColumn("stratum", stratum(F.col(size), strata))
    placed = with_place(placed.where(F.col("stratum").isNotNull()), size)
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for number, (name, _, _) in enumerate(strata):
        rank = rank.when(F.col("stratum") == name, number)
    # One row for each stratum.
    above = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    figures = plan.select(
        F.col("stratum").alias("_s"),
        F.col("boards").alias("n"),
        "target",
        F.coalesce(F.sum("boards").over(above), F.lit(0)).alias("_above"),
    )
    joined = placed.join(figures, F.col("stratum") == F.col("_s"))
    joined = joined.withColumn("place", F.col("place") - F.col("_above")).drop("_above")
    first = F.ceil(F.col("place") * F.col("target") / F.col("n"))
    taken = (first < F.col("target")) & (F.floor(first * F.col("n") / F.col("target")) == F.col("place"))
    return joined.where(taken).drop("_s", "n", "target", "place")


def drawn_boards(sample: DataFrame, plan: DataFrame) -> list[dict]:
    """``bootstrap_draws``'s strata: sampled boards one by one, a census as its sums.

    Only sampled strata, whose sizes the plan bounds, reach the driver.
    """
    figures = {r["stratum"]: r for r in plan.collect()}
    whole = [n for n, r in figures.items() if r["census"]]
    sums = sample.where(F.col("stratum").isin(*whole)).groupBy("stratum")
    sums = sums.agg(F.sum("postings").alias("postings"), F.sum("extra").alias("extra"))
    read = {r["stratum"]: [(r["postings"], r["extra"])] for r in sums.collect()}
    rest = sample.where(~F.col("stratum").isin(*whole)).orderBy(F.desc("postings"), "board")
    for row in rest.select("stratum", "postings", "extra").collect():
        read.setdefault(row["stratum"], []).append((row["postings"], row["extra"]))
    return [
        {"name": n, "weight": r["weight"], "census": r["census"], "boards": read.get(n, [])}
        for n, r in figures.items()
    ]


def stratum_rates(results: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Ratio estimate of each stratum: duplicate postings over postings read.

    With ``planned`` boards (stratum and, where a board was not read, reason)
    failures are counted too.
    """
    if planned is not None:
        return _with_failures(stratum_rates(results), planned)
    return results.groupBy("stratum").agg(
        F.count("*").alias("boards_read"),
        F.sum("postings").alias("postings_read"),
        F.sum("extra").alias("extra"),
        F.count_if(F.col("extra") > 0).alias("boards_with_any"),
        F.try_divide(F.sum("extra"), F.sum("postings")).alias("rate"),
    )


def _with_failures(rates: DataFrame, planned: DataFrame) -> DataFrame:
    counts = planned.groupBy(F.col("stratum").alias("_s"), "reason").agg(F.count("*").alias("n"))
    failed = counts.groupBy("_s").agg(
        F.sum("n").alias("planned"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("failed"),
        F.array_sort(
            F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))
        ).alias("reasons"),
    )
    return failed.join(rates, F.col("stratum") == F.col("_s"), "left").select(
        F.col("_s").alias("stratum"),
        "planned",
        "failed",
        "reasons",
        *[c for c in rates.columns if c != "stratum"],
    )


def combined_rate(rates: DataFrame, plan: DataFrame) -> DataFrame:
    """Weighted rate; weights are renormalised over the strata that answered."""
    weights = plan.select(F.col("stratum").alias("_s"), "weight")
    joined = rates.where("rate is not null").join(weights, F.col("stratum") == F.col("_s"))
    return joined.agg(
        (F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).alias("rate"),
        F.count("*").alias("strata"),
    )


def concentration(results: DataFrame, tops=(1, 10, 25)) -> DataFrame:
    """Share of all duplicates on the worst 1, 10 and 25 boards."""
    worst = results.orderBy(F.desc("extra"), "board").limit(max(tops))
    order = Window.orderBy(F.desc("extra"), "board")
    ranked = worst.withColumn("place", F.row_number().over(order))
    total = results.agg(F.sum("extra").alias("total"), F.count_if(F.col("extra") > 0).alias("boards"))
    heads = ranked.agg(
        *[F.sum(F.when(F.col("place") <= k, F.col("extra"))).alias(f"h{k}") for k in tops]
    )
    shares = [F.try_divide(F.col(f"h{k}"), F.col("total")).alias(f"top_{k}") for k in tops]
    # Two one-row frames.
    return total.join(heads, F.lit(True)).select("total", "boards", *shares)


def _jump(state: int, steps: int) -> int:
    """The generator's state after ``steps`` more draws."""
    a, c, total_a, total_c = LCG_A, LCG_C, 1, 0
    while steps:
        if steps & 1:
            total_a, total_c = total_a * a % LCG_M, (total_c * a + c) % LCG_M
        a, c = a * a % LCG_M, (c * a + c) % LCG_M
        steps >>= 1
    return (total_a * state + total_c) % LCG_M


def bootstrap_draws(
    spark: SparkSession,
    strata: list[dict],
    draws: int = DRAWS,
    seed: int = SEED,
) -> DataFrame:
    """iteration and rate: resampled weighted rates, the same as one sequential loop gives.

    ``strata`` lists name, weight, census and boards [(postings, extra)] in
    order: a documented sample plan, hundreds of boards; a census may come as
    one pair of sums.  A resample draws as many boards as a sampled stratum
    has; censuses draw nothing.  Every
    iteration consumes the same number of draws, so each starts at a known
    state and iterations run anywhere.
    """
    answered = [s for s in strata if s["boards"]]
    per_round = sum(len(s["boards"]) for s in answered if not s["census"])
    arrays = [(s, np.array(s["boards"], dtype=np.float64)) for s in answered]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rates = []
            for k in frame["id"]:
                state = _jump(seed, int(k) * per_round)
                top = weight = 0.0
                for s, boards in arrays:
                    if s["census"]:
                        picked = boards
                    else:
                        places = []
                        for _ in range(len(boards)):
                            state = (state * LCG_A + LCG_C) % LCG_M
                            places.append(state * len(boards) // LCG_M)
                        picked = boards[places]
                    postings, extra = picked.sum(axis=0)
                    if postings:
                        top += s["weight"] * extra / postings
                        weight += s["weight"]
                rates.append(top / weight if weight else None)
            yield pd.DataFrame({"iteration": frame["id"], "rate": rates})

    return spark.range(draws).mapInPandas(run, "iteration long, rate double")


def interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The draws at places floor(q x n) of their order, the last at most."""
    order = Window.orderBy("rate")
    placed = draws.withColumn("place", F.row_number().over(order) - 1)
    n = F.count("*").over(Window.partitionBy())
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    rows = placed.withColumn("n", n)
    pick = lambda q: F.max(F.when(F.col("place") == at(q), F.col("rate")))
    return rows.agg(pick(low).alias("low"), pick(0.5).alias("median"), pick(high).alias("high"))


# The steps of the mulberry32 generator.
_STEP, _FIRST, _SECOND, _THIRD, _SET = 0x6D2B79F5, 15, 7, 14, 61


def _uniform(seed: int) -> Iterator[float]:
    """The mulberry32 generator: 32-bit state, numbers in [0, 1)."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + _STEP) & mask
        mixed = (state ^ state >> _FIRST) * (state | 1) & mask
        mixed ^= mixed + ((mixed ^ mixed >> _SECOND) * (mixed | _SET) & mask) & mask
        yield (mixed ^ mixed >> _THIRD) / (mask + 1)


_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, in steps that fit 64 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + high).bitwiseAND(F.lit(_MASK))


def uniform_at(seed: int, number: Column) -> Column:
    """The generator's number at any place from 0 on, without those before it.

    Its state is the seed plus a multiple of the step, so a draw is a formula
    of its place and rows may draw anywhere, in any order.
    """
    step = F.lit(_STEP).cast("long")
    place = number.cast("long").bitwiseAND(F.lit(_MASK)) + 1
    state = (F.lit(seed & _MASK).cast("long") + _times(place, step)).bitwiseAND(F.lit(_MASK))

    def shifted(x: Column, by: int) -> Column:
        return x.bitwiseXOR(F.shiftrightunsigned(x, by))

    mixed = _times(shifted(state, _FIRST), state.bitwiseOR(F.lit(1).cast("long")))
    more = _times(shifted(mixed, _SECOND), mixed.bitwiseOR(F.lit(_SET).cast("long")))
    mixed = mixed.bitwiseXOR((mixed + more).bitwiseAND(F.lit(_MASK)))
    return shifted(mixed, _THIRD) / F.lit(float(_MASK + 1))


def counter_samples(rows: DataFrame, group: str, item: str, wanted: int, seed: int, least: int = 1) -> DataFrame:
    """Of each group of distinct items a uniform sample: the ``wanted`` items with the least draws.

    An item's draw is the generator's number at the place that its digest
    names, so a sample depends on neither order nor partitions, and lists of
    any length are cut before they are shuffled.  Groups with fewer than
    ``least`` items give nothing; null groups and items are left out.
    """
    known = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).distinct()
    name = F.concat_ws("|", F.col(group).cast("string"), F.col(item).cast("string"))
    place = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    drawn = known.withColumn("draw", uniform_at(seed, place))
    order = Window.partitionBy(group).orderBy("draw", item)
    sample = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    if least > 1:
        large = known.groupBy(group).count().where(F.col("count") >= least).select(group)
        sample = sample.join(large, group, "left_semi")
    return sample.select(group, item, "draw")


def seeded_samples(lists: dict[str, list], wanted: int, seed: int) -> dict[str, list]:
    """A Fisher-Yates sample of each list; one generator serves all, in order.

    The order of draws makes this sequential.  It is for token lists that a
    driver holds anyway; lists no longer than ``wanted`` draw nothing.
    """
    draws, found = _uniform(seed), {}
    for name, items in lists.items():
        pool = list(items)
        if wanted and wanted < len(pool):
            for k in range(len(pool) - 1, 0, -1):
                other = int(next(draws) * (k + 1))
                pool[k], pool[other] = pool[other], pool[k]
            pool = pool[:wanted]
        found[name] = pool
    return found
