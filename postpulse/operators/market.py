"""Market-wide aggregates and the ranked tables of an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.functions.text import round_half_up
from postpulse.operators.signals import days_before

# Floors below which a line is not published.
RAMPING_OPENED, RAMPING_BASELINE = 10, 5
TECH_OPENED, TECH_COMPANIES, CLIMBING_BASELINE = 20, 5, 10


def age_within(posted: Column, as_of: str, days: int) -> Column:
    """At most ``days`` old, the bound included and the future too."""
    return posted >= days_before(as_of, days)


def run_stats(postings: DataFrame, as_of: str) -> DataFrame:
    """One row: boards, postings, dated and opened within 7 and 30 days."""
    posted = F.col("posted_at")
    return postings.agg(
        F.count_distinct("source", "company").alias("boards"),
        F.count("*").alias("postings"),
        F.count("posted_at").alias("dated"),
        F.count_if(age_within(posted, as_of, 7)).alias("opened_7d"),
        F.count_if(age_within(posted, as_of, 30)).alias("opened_30d"),
    )


def recent_breakdown(postings: DataFrame, as_of: str, kinds: tuple[str, ...] = ("seniority", "workplace")) -> DataFrame:
    """kind, value and postings: what the last 30 days opened, by seniority and by workplace.

    The bound and the future are included, undated postings are not; an
    unstated value is counted as null.
    """
    recent = postings.where(age_within(F.col("posted_at"), as_of, 30))
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    each = recent.select(F.explode(items).alias("item"))
    return each.groupBy("item.kind", "item.value").agg(F.count("*").alias("postings"))


def market_technology(mentions: DataFrame, as_of: str) -> DataFrame:
    """Per technology: recent and prior openings, companies hiring, change against baseline.

    ``mentions`` has source, company, posted_at and technology.  Recent is the
    last 30 days, the bound and the future included; prior the 60 before.
    """
    posted = F.col("posted_at")
    recent = age_within(posted, as_of, 30)
    prior = ~recent & age_within(posted, as_of, 90)
    company = F.when(recent, F.struct("source", "company"))
    counts = mentions.groupBy("technology").agg(
        F.count_if(recent).alias("d30"),
        F.count_if(prior).alias("prior60"),
        F.count_distinct(company).alias("companies"),
    )
    baseline = F.col("prior60") / F.lit(2.0)
    ratio = F.when(F.col("prior60") > 0, F.col("d30") / baseline)
    return counts.select(
        "technology",
        "d30",
        "companies",
        baseline.alias("baseline30"),
        round_half_up(ratio, 2).alias("ratio"),
    )


def published_technology(market: DataFrame, limit: int = 25) -> DataFrame:
    fit = (F.col("d30") >= TECH_OPENED) & (F.col("companies") >= TECH_COMPANIES)
    return market.where(fit).orderBy(F.desc("companies"), F.desc("d30"), "technology").limit(limit)


def climbing_technology(market: DataFrame, limit: int = 10) -> DataFrame:
    fit = (F.col("d30") >= TECH_OPENED) & (F.col("companies") >= TECH_COMPANIES)
    fit &= (F.col("baseline30") >= CLIMBING_BASELINE) & F.col("ratio").isNotNull()
    return market.where(fit).orderBy(F.desc("ratio"), "technology").limit(limit)


def ranked_ramping(
    signals: DataFrame,
    limit: int = 20,
    opened: int = RAMPING_OPENED,
    baseline: float = RAMPING_BASELINE,
) -> DataFrame:
    fit = (F.col("signal") == "ramping") & (F.col("opened_30d") >= opened)
    fit &= F.col("baseline_30d") >= baseline
    ratio = F.coalesce("ramp_ratio", F.lit(0.0))
    order = [ratio.desc(), F.desc("opened_30d"), "source", "company"]
    return signals.where(fit).orderBy(*order).limit(limit)


def ranked_new_boards(signals: DataFrame, limit: int = 15) -> DataFrame:
    new = signals.where(F.col("signal") == "new_board")
    return new.orderBy(F.desc("open_postings"), "source", "company").limit(limit)


def ranked_new_functions(found: DataFrame, limit: int = 20) -> DataFrame:
    """Boards by their largest new function; ``found`` is ranked within boards."""
    lead = found.where(F.col("rank") == 1)
    return lead.orderBy(F.desc("count"), "source", "company").limit(limit)


def ranked_executive_openings(postings: DataFrame, as_of: str, limit: int = 15) -> DataFrame:
    """Boards by executive openings of the last 90 days, future ones included."""
    recent = postings.where(
        (F.col("seniority") == "executive") & (F.col("posted_at") > days_before(as_of, 90))
    )
    counts = recent.groupBy("source", "company").agg(F.count("*").alias("executive_openings_90d"))
    return counts.orderBy(F.desc("executive_openings_90d"), "source", "company").limit(limit)


def breakdown(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal").agg(
        F.count("*").alias("boards"), F.sum("open_postings").alias("open_postings")
    )


def summed_top_technology(ranked: DataFrame) -> DataFrame:
    """The market by boards' own top lists; what a board's list cut off is not in it."""
    return ranked.groupBy(F.col("name").alias("technology")).agg(
        F.sum("count").alias("postings"), F.count("*").alias("boards")
    )


def enrichment_shares(postings: DataFrame) -> DataFrame:
    """Shares of postings with a salary and of remote ones, to three digits."""
    share = lambda c: round_half_up(F.count_if(c) / F.count(F.lit(1)), 3)
    return postings.agg(
        F.count("*").alias("postings"),
        share(F.col("salary_min").isNotNull()).alias("with_salary"),
        share(F.col("workplace") == "remote").alias("remote"),
    )
