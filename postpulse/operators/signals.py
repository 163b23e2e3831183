"""Per-company hiring signals over fixed windows before one instant.

``as_of`` is an argument everywhere: nothing reads the clock.  The windows are
conditional counts, so a company's whole signal is one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions import lexicons as lex
from postpulse.functions.text import round_half_up, technologies

# The thresholds of the labels.
RAMP_LEAST_OPENED = 3
RAMP_LEAST_RATIO = 2
NEW_BOARD_DAYS = 60
NEW_FUNCTION_DAYS = 45
NEW_FUNCTION_HISTORY = 5
NEW_FUNCTION_ROLES = 2
NEW_FUNCTION_DEPARTMENTS = 25
STEADY_LEAST = 1
TOP_DEPARTMENTS, TOP_TITLES, TOP_TECHNOLOGIES = 5, 5, 12

KEYS = ("source", "company")


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of: str, days: int) -> Column:
    return instant(as_of) - F.make_interval(days=F.lit(days))


def within(posted: Column, as_of: str, start: int, end: int = 0) -> Column:
    """Posted more than ``end`` and up to ``start`` days before: open below, closed above."""
    return (posted > days_before(as_of, start)) & (posted <= days_before(as_of, end))


def signal_label(
    dated: Column, oldest: Column, opened: Column, ratio: Column, as_of: str
) -> Column:
    """undated, new_board, ramping, steady or quiet, the first that holds."""
    ramps = ratio.isNull() | (ratio >= RAMP_LEAST_RATIO)
    return (
        F.when(dated == 0, "undated")
        .when(oldest > days_before(as_of, NEW_BOARD_DAYS), "new_board")
        .when((opened >= RAMP_LEAST_OPENED) & ramps, "ramping")
        .when(opened >= STEADY_LEAST, "steady")
        .otherwise("quiet")
    )


def company_signal(
    postings: DataFrame,
    as_of: str,
    keys: tuple[str, ...] = KEYS,
    more: tuple[Column, ...] = (),
) -> DataFrame:
    """One row for each board: windows, baseline, ratio and label, then ``more`` aggregates.

    ``postings`` has the keys and ``posted_at`` (null if undated).  The ratio is
    the last 30 days against half of the 60 before; null without a baseline.
    """
    posted = F.col("posted_at")
    counts = postings.groupBy(*keys).agg(
        F.count("*").alias("open_postings"),
        F.count("posted_at").alias("postings_dated"),
        F.count_if(within(posted, as_of, 7)).alias("opened_7d"),
        F.count_if(within(posted, as_of, 30)).alias("opened_30d"),
        F.count_if(within(posted, as_of, 90)).alias("opened_90d"),
        F.count_if(within(posted, as_of, 90, 30)).alias("opened_prior"),
        F.min("posted_at").alias("oldest_posting_at"),
        F.max("posted_at").alias("newest_posting_at"),
        F.struct(F.lit(0).alias("nothing"), *more).alias("more"),
    )
    return labelled(counts, as_of, keys, ("more.*",)).drop("nothing")


def labelled(
    counts: DataFrame, as_of: str, keys: tuple[str, ...] = KEYS, more: tuple[str, ...] = ()
) -> DataFrame:
    """Counts of boards (as ``company_signal`` makes them) with baseline, ratio and label."""
    baseline = F.col("opened_prior") / F.lit(2.0)
    ratio = round_half_up(F.when(F.col("opened_prior") > 0, F.col("opened_30d") / baseline), 2)
    label = signal_label(
        F.col("postings_dated"),
        F.col("oldest_posting_at"),
        F.col("opened_30d"),
        ratio,
        as_of,
    )
    return counts.select(
        *keys,
        label.alias("signal"),
        "open_postings",
        "postings_dated",
        "opened_7d",
        "opened_30d",
        "opened_90d",
        baseline.alias("baseline_30d"),
        ratio.alias("ramp_ratio"),
        "oldest_posting_at",
        "newest_posting_at",
        *more,
    )


def new_functions(
    postings: DataFrame, as_of: str, keys: tuple[str, ...] = KEYS, limit: int = 5
) -> DataFrame:
    """Departments that a board with some history opened only lately, largest first.

    Departments that read like places do not count.  Two partial aggregations
    on the board's key: by department, then by board.
    """
    cutoff = days_before(as_of, NEW_FUNCTION_DAYS)
    dated = postings.where(F.col("posted_at").isNotNull())
    named = F.col("department").isNotNull() & (F.col("department") != "")
    real = named & ~F.col("department").rlike(lex.PLACE_LIKE)
    by_department = dated.groupBy(*keys, F.when(real, F.col("department")).alias("name")).agg(
        F.count("*").alias("count"), F.min("posted_at").alias("oldest")
    )
    board = Window.partitionBy(*keys)
    order = board.orderBy(F.desc("count"), "name")
    return (
        by_department.withColumns(
            {
                "history": F.sum("count").over(board),
                "first": F.min("oldest").over(board),
                "departments": F.count("name").over(board),
            }
        )
        .where(
            (F.col("history") >= NEW_FUNCTION_HISTORY)
            & (F.col("first") <= cutoff)
            & (F.col("departments") <= NEW_FUNCTION_DEPARTMENTS)
            & F.col("name").isNotNull()
            & (F.col("oldest") > cutoff)
            & (F.col("count") >= NEW_FUNCTION_ROLES)
        )
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(*keys, "rank", "name", "count")
    )


def top_counts(
    rows: DataFrame, value: str, limit: int, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """The commonest non-empty values of each board: count descending, then name."""
    counts = (
        rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy(*keys, F.col(value).alias("name"))
        .agg(F.count("*").alias("count"))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "name")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select(*keys, "rank", "name", "count")


def technology_counts(
    rows: DataFrame, labels: Column, as_of: str, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Postings by technology over the last 90 days: open below, future included."""
    recent = rows.where(F.col("posted_at") > days_before(as_of, 90))
    exploded = recent.select(*keys, F.explode(labels).alias("technology"))
    return exploded.groupBy(*keys, "technology").agg(F.count("*").alias("count"))


def signal_records(
    postings: DataFrame,
    as_of: str,
    keys: tuple[str, ...] = KEYS,
    use_description: bool = False,
    top_departments: int = TOP_DEPARTMENTS,
    top_technologies: int = TOP_TECHNOLOGIES,
) -> DataFrame:
    """A board's whole record: its signal, counts and four ranked arrays of (name, count).

    ``postings`` has title, department, team, description, workplace, seniority
    and salary_min besides.  Technologies are read in title, team and
    department of the last 90 days, in descriptions only if asked.  Boards
    without entries of a kind have an empty array.

    Postings are read twice: for the counts of a board, and for the names of
    all four kinds, which one partial aggregation counts and one window of a
    board and kind ranks.
    """
    posted = F.col("posted_at")
    recent = posted > days_before(as_of, 90)
    more = (
        F.count_if(recent & (F.col("seniority") == "executive")).alias("executive_openings_90d"),
        F.count_if(F.col("workplace") == "remote").alias("remote_postings"),
        F.count_if(F.col("salary_min").isNotNull()).alias("postings_with_salary"),
    )
    record = company_signal(postings, as_of, keys, more)
    where = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "team", "department")])
    text = F.concat_ws(" ", where, F.coalesce("description", F.lit(""))) if use_description else where
    named = F.coalesce(F.col("department"), F.lit("")) != ""
    real = named & ~F.col("department").rlike(lex.PLACE_LIKE)

    def one(kind: str, name: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    def some(condition: Column, items: Column) -> Column:
        return F.when(condition, items).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))

    labels = F.transform(
        technologies(text, where), lambda t: F.struct(F.lit("tech_signals").alias("kind"), t.alias("name"))
    )
    items = F.concat(
        some(named, one("top_departments", F.col("department"))),
        some(F.coalesce("title", F.lit("")) != "", one("top_titles", F.col("title"))),
        some(posted.isNotNull(), one("new_functions", F.when(real, F.col("department")))),
        some(F.coalesce(recent, F.lit(False)), labels),
    )
    counts = (
        postings.select(*keys, "posted_at", F.explode(items).alias("item"))
        .groupBy(*keys, "item.kind", "item.name")
        .agg(F.count("*").alias("count"), F.min("posted_at").alias("oldest"))
    )
    of_kind = Window.partitionBy(*keys, "kind")
    cutoff = days_before(as_of, NEW_FUNCTION_DAYS)
    facts = counts.withColumns(
        {
            "history": F.sum("count").over(of_kind),
            "first": F.min("oldest").over(of_kind),
            "names": F.count("name").over(of_kind),
        }
    )
    is_new = (
        (F.col("history") >= NEW_FUNCTION_HISTORY)
        & (F.col("first") <= cutoff)
        & (F.col("names") <= NEW_FUNCTION_DEPARTMENTS)
        & F.col("name").isNotNull()
        & (F.col("oldest") > cutoff)
        & (F.col("count") >= NEW_FUNCTION_ROLES)
    )
    kept = facts.where((F.col("kind") != "new_functions") | is_new)
    most = {
        "new_functions": 5,
        "top_departments": top_departments,
        "top_titles": TOP_TITLES,
        "tech_signals": top_technologies,
    }
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    ranked = kept.withColumn("rank", F.row_number().over(of_kind.orderBy(F.desc("count"), "name")))
    ranked = ranked.where(F.col("rank") <= limit[F.col("kind")])
    entries = F.array_sort(F.collect_list(F.struct("kind", "rank", "name", "count")))
    folded = ranked.groupBy(*keys).agg(entries.alias("entries"))
    empty = F.array().cast("array<struct<name:string,count:bigint>>")

    def of(kind: str) -> Column:
        own = F.filter("entries", lambda e: e["kind"] == kind)
        return F.transform(own, lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count")))

    joined = record.join(folded, list(keys), "left")
    return joined.select(*record.columns, *[F.coalesce(of(kind), empty).alias(kind) for kind in most])


def delivered(records: DataFrame, signals: tuple[str, ...] = (), least_open: int = 0) -> DataFrame:
    """Records with enough open postings and one of the wanted signals (none wanted: any)."""
    keep = F.col("open_postings") >= least_open
    if signals:
        keep &= F.col("signal").isin(*signals)
    return records.where(keep)


def preview(postings: DataFrame, as_of: str, boards: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The ``boards`` largest boards of each source: their signal and the share of dated postings."""
    record = company_signal(postings, as_of, keys)
    order = Window.partitionBy(keys[0]).orderBy(F.desc("open_postings"), *keys[1:])
    ranked = record.withColumn("place", F.row_number().over(order)).where(F.col("place") <= boards)
    share = round_half_up(F.col("postings_dated") * 100.0 / F.col("open_postings"), 1)
    return ranked.withColumn("dated_pct", share)


def real_departments(postings: DataFrame) -> DataFrame:
    """Postings whose department is stated and neither a place nor a cost-centre code."""
    named = F.coalesce("department", F.lit("")) != ""
    return postings.where(
        named & ~F.col("department").rlike(lex.PLACE_LIKE) & ~F.col("department").rlike(lex.CODE_LIKE)
    )


def by_recent_openings(records: DataFrame) -> DataFrame:
    """The full market list: recent openings first, then by company and source."""
    return records.orderBy(F.desc("opened_30d"), "company", "source")
