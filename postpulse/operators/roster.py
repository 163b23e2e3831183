"""Probe verdicts, layered rosters, coverage and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions.text import round_half_up

STATUSES = ("live", "empty", "dead", "error", "blocked")
# The gate a corpus has to pass.
GATE_COMPANIES, GATE_POSTINGS = 10_000, 150_000


def probe_status(http: Column, shape_ok: Column, jobs: Column) -> Column:
    """live, empty, dead, error or blocked from one reply; a null code is no reply."""
    return (
        F.when(http.isNull(), "error")
        .when(http.isin(404, 410), "dead")
        .when(http.isin(403, 429) | (http >= 500), "blocked")
        .when((http < 200) | (http >= 300), "dead")
        .when(~F.coalesce(shape_ok, F.lit(False)), "dead")
        .when(jobs > 0, "live")
        .otherwise("empty")
    )


def layered(runs: DataFrame, keys: tuple[str, ...], ordinal: str) -> DataFrame:
    """Of each key the row of its latest run: one partial aggregation, no sort.

    Rows of one run that share a key are ordered by their other columns.
    """
    rest = [c for c in runs.columns if c not in keys]
    others = [c for c in rest if c != ordinal]
    row = F.struct(*rest)
    top = runs.groupBy(*keys).agg(F.max_by(row, F.struct(ordinal, *others)).alias("row"))
    return top.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def coverage_summary(probes: DataFrame, by: str = "provider") -> DataFrame:
    """Per provider: verdict counts, postings, hit rate and the upper median of live boards.

    The median needs the exact middle of the sorted counts; counts are
    aggregated to (provider, count) first, so what is ordered is distinct counts.
    """
    status = F.col("status")
    sums = probes.groupBy(by).agg(
        F.count("*").alias("candidates"),
        *[F.count_if(status == s).alias(s) for s in STATUSES],
        F.coalesce(F.sum(F.when(status == "live", F.col("jobs"))), F.lit(0)).alias("postings"),
    )
    resolved = F.col("candidates") - F.col("blocked")
    rate = F.when(resolved > 0, F.col("live") / resolved)
    medians = upper_median(probes.where(status == "live"), "jobs", by)
    joined = sums.join(medians.withColumnRenamed(by, "_by"), F.col(by) == F.col("_by"), "left")
    return joined.select(
        by,
        "candidates",
        *STATUSES,
        "postings",
        resolved.alias("resolved"),
        round_half_up(rate, 4).alias("hit_rate"),
        F.col("median").alias("median_live"),
    )


def upper_median(rows: DataFrame, value: str, by: str) -> DataFrame:
    """by and median: the value at index floor(n / 2) of the ascending order."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    total = F.sum("n").over(Window.partitionBy(by))
    running = counts.withColumns({"up_to": F.sum("n").over(order), "total": total})
    past = running.where(F.col("up_to") > F.floor(F.col("total") / 2))
    return past.groupBy(by).agg(F.min(value).alias("median"))


def coverage_projection(summary: DataFrame, harvested: DataFrame, by: str = "provider") -> DataFrame:
    """Live boards and postings projected from probed to harvested tokens."""
    joined = summary.join(harvested.select(F.col(by).alias("_by"), "harvested"), F.col(by) == F.col("_by"))
    scale = F.col("harvested") / F.col("candidates")
    rounded = lambda c: F.floor(F.col(c) * scale + 0.5).cast("long")
    return joined.select(
        by,
        "candidates",
        "harvested",
        rounded("live").alias("projected_live"),
        rounded("postings").alias("projected_postings"),
    )


def gate(projection: DataFrame) -> DataFrame:
    """One row: totals and whether both reach the gate."""
    totals = projection.agg(
        F.sum("projected_live").alias("companies"), F.sum("projected_postings").alias("postings")
    )
    passed = (F.col("companies") >= GATE_COMPANIES) & (F.col("postings") >= GATE_POSTINGS)
    return totals.withColumn("passed", F.coalesce(passed, F.lit(False)))


def coverage_rollup(probes: DataFrame, by: str = "provider") -> DataFrame:
    """Verdict counts by provider and, under the name "all", in total."""
    rows = probes.rollup(by).agg(
        F.grouping(by).alias("is_total"),
        F.count("*").alias("candidates"),
        F.count_if(F.col("status") == "live").alias("live"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.coalesce(F.sum(F.when(F.col("status") == "live", F.col("jobs"))), F.lit(0)).alias("postings"),
    )
    gone = F.col("candidates") - F.col("live") - F.col("empty")
    name = F.when(F.col("is_total") == 1, "all").otherwise(F.col(by))
    return rows.select(
        name.alias(by),
        "candidates",
        "live",
        "empty",
        gone.alias("dead"),
        "postings",
        round_half_up(F.col("live") * 100.0 / F.col("candidates"), 1).alias("live_pct"),
    )


def merged_candidates(*harvests: DataFrame) -> DataFrame:
    """Distinct (provider, token) of all harvests."""
    parts = [h.select("provider", "token") for h in harvests]
    return reduce(DataFrame.unionByName, parts).distinct()


def not_yet(candidates: DataFrame, done: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Candidates whose key is not among those done: resuming, or what is unverified."""
    return candidates.join(done.select(*keys).distinct(), list(keys), "left_anti")


def roster_difference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every (provider, token) as shared, ours_only, theirs_only or ours_custom_domain.

    A token of ours is on a custom domain if its letters and digits are those of
    a company name of theirs at the same provider.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    left = ours.select("provider", "token").distinct().withColumn("ours", F.lit(True))
    right = theirs.select("provider", "token").distinct().withColumn("theirs", F.lit(True))
    both = left.join(right, ["provider", "token"], "full_outer")
    names = theirs.select("provider", bare("company").alias("name")).where("name <> ''").distinct()
    names = names.withColumn("named", F.lit(True))
    joined = both.withColumn("name", bare("token")).join(names, ["provider", "name"], "left")
    kind = (
        F.when(F.col("ours") & F.col("theirs"), "shared")
        .when(F.col("theirs"), "theirs_only")
        .when(F.col("named"), "ours_custom_domain")
        .otherwise("ours_only")
    )
    return joined.select("provider", "token", kind.alias("kind"))


def cross_pairs(tokens: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """source_provider, target_provider and token: each token at every provider but its own.

    ``tokens`` has provider and token; each row becomes a few, without a join.
    """
    targets = F.array_remove(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    return tokens.where(F.col("provider").isin(*providers)).select(
        F.col("provider").alias("source_provider"), F.explode(targets).alias("target_provider"), "token"
    )


def cross_hits(probes: DataFrame) -> DataFrame:
    """Hit rate of tokens of one provider tried at another."""
    counts = probes.groupBy("source_provider", "target_provider").agg(
        F.count("*").alias("tried"), F.count_if(F.col("status") == "live").alias("hits")
    )
    return counts.withColumn("hit_rate", round_half_up(F.col("hits") / F.col("tried"), 4))


def boards_to_read(
    roster: DataFrame,
    most: int,
    providers: tuple[str, ...] = (),
    with_empty: bool = False,
    with_unverified: bool = False,
) -> DataFrame:
    """Of each provider the ``most`` largest boards: live by postings, then empty, then unverified.

    ``roster`` has provider, token, status and open_postings; ``place`` is the
    turn within the provider, ties by token.
    """
    wanted = ["live", *["empty"] * with_empty, *["unverified"] * with_unverified]
    rows = roster.where(F.col("status").isin(*wanted))
    if providers:
        rows = rows.where(F.col("provider").isin(*providers))
    group = F.array_position(F.array(*map(F.lit, wanted)), F.col("status"))
    order = Window.partitionBy("provider").orderBy(group, F.desc("open_postings"), "token")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reprobed(latest: DataFrame, again: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """``latest`` with the boards of ``statuses`` as a later, slower run found them.

    Both have provider, token, run, jobs and status; a board the later run
    could not settle keeps what was known.
    """
    keys = ("provider", "token")
    asked = latest.where(F.col("status").isin(*statuses)).select(*keys)
    answered = again.join(asked, list(keys), "left_semi").where(~F.col("status").isin("error", "blocked"))
    return layered(latest.unionByName(answered.select(*latest.columns)), keys, "run")


def board_search(boards: DataFrame, text: str) -> DataFrame:
    """Boards whose token holds ``text``, whatever the case; all for an empty text."""
    return boards.where(F.lower("token").contains(text.strip().lower()))


def roster_order(boards: DataFrame) -> DataFrame:
    """Live boards, most postings first, then by token."""
    return boards.where(F.col("status") == "live").orderBy(F.desc("open_postings"), "token")
