"""Posting filters, and counts of what each rule would match."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postpulse.functions.text import is_recruitment_ad, is_volunteer_listing


@dataclass(frozen=True)
class PostingFilter:
    """Which postings to keep; an empty setting does not filter."""

    keywords: tuple[str, ...] = ()
    location: str = ""
    department: str = ""
    workplaces: tuple[str, ...] = ()
    seniorities: tuple[str, ...] = ()
    with_salary: bool = False
    posted_since: str = ""
    drop_recruitment_ads: bool = False
    drop_volunteer: bool = False

    def condition(self) -> Column:
        keep = F.lit(True)
        if self.keywords:
            parts = [
                F.coalesce(F.col(c), F.lit(""))
                for c in ("title", "department", "team", "description")
            ]
            hay = F.lower(F.concat_ws(" ", *parts))
            keep &= F.exists(
                F.array(*[F.lit(k.lower()) for k in self.keywords]), lambda k: F.contains(hay, k)
            )
        for column, part in (("location", self.location), ("department", self.department)):
            if part:
                keep &= F.lower(F.coalesce(F.col(column), F.lit(""))).contains(part.lower())
        if self.workplaces:
            keep &= F.col("workplace").isin(*self.workplaces)
        if self.seniorities:
            keep &= F.col("seniority").isin(*self.seniorities)
        if self.with_salary:
            keep &= F.col("salary_min").isNotNull()
        if self.posted_since:
            changed = F.coalesce("updated_at", "posted_at")
            keep &= F.coalesce(changed >= F.lit(self.posted_since).cast("timestamp"), F.lit(False))
        if self.drop_recruitment_ads:
            keep &= ~is_recruitment_ad("title")
        if self.drop_volunteer:
            keep &= ~is_volunteer_listing("title")
        return keep


def valid_postings(postings: DataFrame) -> DataFrame:
    """Rows with a title and an id; a missing id does not pass as a word."""
    return postings.where(
        (F.coalesce("title", F.lit("")) != "") & (F.coalesce("job_id", F.lit("")) != "")
    )


def observed(postings: DataFrame, name: str = "rules") -> tuple[DataFrame, Observation]:
    """``postings`` with independent rule counters, filled in by whatever action runs."""
    seen = Observation(name)
    return postings.observe(seen, *rule_counts()), seen


def rule_counts(title: str = "title") -> list[Column]:
    """One count for each rule, independent of the others and of any filter."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_recruitment_ad(title)).alias("recruitment_ads"),
        F.count_if(is_volunteer_listing(title)).alias("volunteer_unpaid"),
    ]


def exclusive_quality(postings: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Per board: ads, else volunteer listings, and their share; a row counts once."""
    ad, volunteer = is_recruitment_ad("title"), is_volunteer_listing("title")
    counts = postings.groupBy(*keys).agg(
        F.count("*").alias("titles_read"),
        F.count_if(ad).alias("recruitment_ads"),
        F.count_if(~ad & volunteer).alias("volunteer_unpaid"),
    )
    bad = F.col("recruitment_ads") + F.col("volunteer_unpaid")
    return counts.withColumns({"not_jobs": bad, "not_jobs_share": bad / F.col("titles_read")})


def worst_quality(quality: DataFrame, limit: int, *ties: str) -> DataFrame:
    """Boards with any listing that is no job: largest share first, then most of them."""
    some = quality.where("not_jobs > 0")
    return some.orderBy(F.desc("not_jobs_share"), F.desc("not_jobs"), *ties).limit(limit)


def listing_stale_fields(
    listing: DataFrame, fields: Iterable[str], roster_text: str, providers: Iterable[str]
) -> DataFrame:
    """The text fields of a listing that name neither the roster's count nor all providers."""
    names = list(providers)

    def stale(field: str) -> Column:
        text = F.lower(F.coalesce(F.col(field), F.lit("")))
        wrong = ~text.contains(roster_text.lower())
        for name in names:
            wrong |= ~text.contains(name.lower())
        return F.when((text != "") & wrong, F.lit(field))

    found = F.array_compact(F.array(*[stale(f) for f in fields]))
    return listing.withColumn("stale_fields", found)


def boards_asked(asked: DataFrame, homes: DataFrame, selected: Iterable[str]) -> DataFrame:
    """``provider:token`` or bare tokens as (provider, token) pairs.

    A bare token goes to its home providers, or to every selected one without.
    """
    parts = F.split("board", ":", 2)
    split = asked.select(
        F.when(F.size(parts) == 2, parts[0]).alias("stated"),
        F.lower(F.trim(F.element_at(parts, -1))).alias("token"),
    )
    every = F.array(*map(F.lit, selected))
    home = homes.groupBy(F.col("token").alias("_t")).agg(F.collect_set("provider").alias("home"))
    joined = split.join(home, F.col("token") == F.col("_t"), "left")
    providers = F.when(F.col("stated").isNotNull(), F.array("stated")).otherwise(
        F.coalesce("home", every)
    )
    return joined.select(F.explode(providers).alias("provider"), "token").distinct()
