"""Queries on issues: market aggregates, ranked tables and what changed between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators import diff, market, signals
from postpulse.plans import bindings as b
from postpulse.plans import catalogue
from postpulse.plans.boards import SIGNALS, board_signals, full_postings, signal_new_functions
from postpulse.plans.catalogue import query

NOW = f"TIMESTAMP '{b.AS_OF}'"
LATER = f"TIMESTAMP '{b.LATER_AS_OF}'"
SIGNALLED = f"signalled AS ({SIGNALS.format(as_of=b.AS_OF)})"

@query(
    b.with_ctes(
        ("postings",),
        f"""
SELECT count(DISTINCT (source, company)) AS boards, count(*) AS postings, count(posted_at) AS dated,
  count(*) FILTER (WHERE posted_at >= {NOW} - INTERVAL 7 DAY) AS opened_7d,
  count(*) FILTER (WHERE posted_at >= {NOW} - INTERVAL 30 DAY) AS opened_30d FROM postings""",
    )
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.run_stats(b.postings(spark, sf_dir), b.AS_OF)


@query(
    b.with_ctes(
        ("postings", "role_facts"),
        """
SELECT 'seniority' AS kind, seniority AS value, count(*) AS postings FROM recent GROUP BY 2
UNION ALL SELECT 'workplace', workplace, count(*) FROM recent GROUP BY 2""",
        (
            f"""recent AS (SELECT seniority, CASE WHEN pos % 4 = 1 THEN 'remote' ELSE 'onsite' END AS workplace
  FROM postings JOIN role_facts ON role = pos % 54 WHERE posted_at >= {NOW} - INTERVAL 30 DAY)""",
        ),
    )
)
def recent_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.recent_breakdown(full_postings(spark, sf_dir), b.AS_OF)


MARKET = f"""market AS (
  SELECT technology, d30, companies, prior60 / 2.0::DOUBLE AS baseline30,
    CASE WHEN prior60 > 0 THEN floor(d30 / (prior60 / 2.0::DOUBLE) * 100 + 0.5) / 100 END AS ratio
  FROM (SELECT technology,
      count(*) FILTER (WHERE posted_at >= {LATER} - INTERVAL 30 DAY) AS d30,
      count(*) FILTER (WHERE posted_at < {LATER} - INTERVAL 30 DAY AND posted_at >= {LATER} - INTERVAL 90 DAY) AS prior60,
      count(DISTINCT CASE WHEN posted_at >= {LATER} - INTERVAL 30 DAY THEN (source, company) END) AS companies
    FROM mentions WHERE posted_at <= {LATER} GROUP BY 1))"""


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.lit(b.LATER_AS_OF).cast("timestamp_ntz")
    rows = b.mentions(spark, sf_dir).where(F.col("posted_at") <= until)
    return market.market_technology(rows, b.LATER_AS_OF)


@query(b.with_ctes(("mentions",), "SELECT * FROM market", (MARKET,)))
def market_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir)


@query(
    b.with_ctes(
        ("mentions",),
        """
SELECT * FROM market WHERE d30 >= 20 AND companies >= 5
ORDER BY companies DESC, d30 DESC, technology LIMIT 25""",
        (MARKET,),
    )
)
def market_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.published_technology(_market(spark, sf_dir))


@query(
    b.with_ctes(
        ("mentions",),
        """
SELECT * FROM market WHERE d30 >= 20 AND companies >= 5 AND baseline30 >= 10 AND ratio IS NOT NULL
ORDER BY ratio DESC, technology LIMIT 10""",
        (MARKET,),
    )
)
def market_climbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.climbing_technology(_market(spark, sf_dir))


@query(
    b.with_ctes(
        ("mentions",),
        """
SELECT name AS technology, sum(count)::BIGINT AS postings, count(*) AS boards FROM (
  SELECT company, technology AS name, count(*) AS count,
    row_number() OVER (PARTITION BY source, company ORDER BY count(*) DESC, technology) AS rank
  FROM mentions GROUP BY source, company, technology) WHERE rank <= 12 GROUP BY 1""",
    )
)
def market_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = signals.top_counts(b.mentions(spark, sf_dir), "technology", 12)
    return market.summed_top_technology(ranked)


@query(
    b.with_ctes(
        ("postings",),
        "SELECT signal, count(*) AS boards, sum(open_postings)::BIGINT AS open_postings"
        " FROM signalled GROUP BY 1",
        (SIGNALLED,),
    )
)
def signal_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.breakdown(board_signals(spark, sf_dir))


@query(
    b.with_ctes(
        ("postings",),
        """
SELECT * FROM signalled WHERE signal = 'ramping' AND opened_30d >= 3 AND baseline_30d >= 0.5
ORDER BY coalesce(ramp_ratio, 0) DESC, opened_30d DESC, source, company LIMIT 20""",
        (SIGNALLED,),
    )
)
def ranked_ramping(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Boards of orders are smaller than the published floors ask.
    return market.ranked_ramping(board_signals(spark, sf_dir), opened=3, baseline=0.5)


@query(
    b.with_ctes(
        ("postings",),
        """
SELECT * FROM signalled WHERE signal = 'new_board'
ORDER BY open_postings DESC, source, company LIMIT 15""",
        (SIGNALLED,),
    )
)
def ranked_new_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ranked_new_boards(board_signals(spark, sf_dir))


@query(
    b.with_ctes(
        ("postings",),
        """
SELECT source, company, count(*) AS executive_openings_90d FROM postings
WHERE status = 'F' AND posted_at > TIMESTAMP '1995-05-01' - INTERVAL 90 DAY
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""",
    )
)
def ranked_executive_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("status") == "F", "executive").otherwise("mid")
    rows = b.postings(spark, sf_dir).withColumn("seniority", level)
    return market.ranked_executive_openings(rows, b.AS_OF)


@query(
    b.with_ctes(
        (),
        "SELECT * FROM found WHERE rank = 1 ORDER BY count DESC, source, company LIMIT 20",
        (f"found AS ({catalogue.sql_of('signal_new_functions')})",),
    )
)
def ranked_new_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ranked_new_functions(signal_new_functions(spark, sf_dir))


ISSUES = ("previous", "current", "unread_previous", "unread_current")
CHANGES = """changes AS (
  SELECT source, company, prev_open, open, delta,
    coalesce(delta > 0, false) AS grew, coalesce(delta < 0, false) AS shrank,
    coalesce(delta IS NOT NULL AND signal = 'ramping' AND prev_signal <> 'ramping', false) AS became_ramping,
    coalesce(delta IS NOT NULL AND prev_signal = 'ramping' AND signal <> 'ramping', false) AS stopped_ramping,
    prev_open IS NULL AND NOT EXISTS (FROM unread_previous u WHERE u.source = x.source AND u.company = x.company) AS appeared,
    open IS NULL AND NOT EXISTS (FROM unread_current u WHERE u.source = x.source AND u.company = x.company) AS went_quiet
  FROM (SELECT source, company, p.open AS prev_open, c.open AS open, c.open - p.open AS delta,
      p.signal AS prev_signal, c.signal AS signal
    FROM (FROM previous WHERE (source, company) NOT IN (FROM unread_previous)) p
    FULL JOIN (FROM current WHERE (source, company) NOT IN (FROM unread_current)) c USING (source, company)) x)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["source", "company"]
    missed = [b.unread(spark, sf_dir, r) for r in (3, 7)]
    issues = [
        b.snapshot(spark, sf_dir, day).join(gone, keys, "left_anti")
        for day, gone in zip((b.EARLIER, b.AS_OF), missed, strict=True)
    ]
    return diff.board_changes(*issues, *missed)


@query(b.with_ctes(ISSUES, "SELECT * FROM changes", (CHANGES,)))
def digest_diff_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


LISTS = "UNION ALL ".join(
    f"SELECT '{c}' AS class, * FROM changes WHERE {c} " for c in diff.CLASSES
)


@query(
    b.with_ctes(
        ISSUES,
        f"""
SELECT class, CAST(rank AS INTEGER) AS rank, source, company, prev_open, open, delta FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY
    CASE WHEN class IN ('shrank', 'stopped_ramping') THEN -delta ELSE coalesce(delta, open, prev_open) END DESC,
    source, company) AS rank FROM ({LISTS})) WHERE rank <= 15""",
        (CHANGES,),
    )
)
def digest_diff_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_lists(_changes(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in diff.CLASSES)


@query(
    b.with_ctes(
        ISSUES,
        f"""
SELECT count(delta) AS common, sum(greatest(coalesce(delta, 0), 0))::BIGINT AS gross_up,
  sum(greatest(-coalesce(delta, 0), 0))::BIGINT AS gross_down, sum(coalesce(delta, 0))::BIGINT AS net,
  {_COUNTS} FROM changes""",
        (CHANGES,),
    )
)
def digest_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.gross_changes(_changes(spark, sf_dir))


def _tech_companies(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    limit = F.lit(day).cast("timestamp_ntz")
    recent = F.col("posted_at").between(limit - F.make_interval(days=F.lit(30)), limit)
    rows = b.mentions(spark, sf_dir).where(recent)
    return rows.groupBy("technology").agg(F.count_distinct("company").alias("companies"))


_TECH = """{name} AS (SELECT technology, count(DISTINCT company) AS companies FROM mentions
  WHERE posted_at BETWEEN TIMESTAMP '{day}' - INTERVAL 30 DAY AND TIMESTAMP '{day}' GROUP BY 1)"""


@query(
    b.with_ctes(
        ("mentions",),
        """
SELECT c.technology, c.companies, p.companies AS prev_companies, c.companies - p.companies AS delta,
  p.companies IS NULL AS entered
FROM tech_now c LEFT JOIN tech_before p USING (technology)
WHERE p.companies IS NULL OR c.companies <> p.companies""",
        (
            _TECH.format(name="tech_before", day=b.EARLIER),
            _TECH.format(name="tech_now", day=b.AS_OF),
        ),
    )
)
def digest_diff_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = [_tech_companies(spark, sf_dir, d) for d in (b.EARLIER, b.AS_OF)]
    return diff.technology_changes(*days)


_TOP = """{name} AS (SELECT source, company FROM {issue} ORDER BY open DESC, source, company LIMIT 100)"""


@query(
    b.with_ctes(
        ISSUES,
        """
SELECT *, 'entered' AS change FROM (FROM top_now EXCEPT FROM top_before)
UNION ALL SELECT *, 'left' FROM (FROM top_before EXCEPT FROM top_now)""",
        (
            _TOP.format(name="top_before", issue="previous"),
            _TOP.format(name="top_now", issue="current"),
        ),
    )
)
def digest_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = [
        b.snapshot(spark, sf_dir, d).orderBy(F.desc("open"), "source", "company").limit(100)
        for d in (b.EARLIER, b.AS_OF)
    ]
    return diff.list_entries(*tops)


def _event_day(spark: SparkSession, sf_dir: str, first: str, last: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    day = F.col("ts").cast("timestamp_ntz").cast("date")
    rows = events.where(day.between(first, last))
    return rows.groupBy(
        F.concat(F.lit("g"), F.col("user_id") % 4).alias("source"),
        F.concat(F.lit("u"), "user_id").alias("company"),
    ).agg((F.count("*") - F.count_if(F.col("event_type") == "error")).alias("open"))


_EVENTS = """{name} AS (SELECT 'g' || (user_id % 4) AS source, 'u' || user_id AS company,
  count(*) - count(*) FILTER (WHERE event_type = 'error') AS open FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY 1, 2)"""
_DAYS = (("2024-01-02", "2024-01-04"), ("2024-01-05", "2024-01-09"))


@query(
    b.with_ctes(
        (),
        """
SELECT source, company, was, now, now - was AS delta, signal FROM (
  SELECT *, CASE WHEN was IS NULL AND source <> 'g3' AND now > 0 THEN 'new_board'
    WHEN was > 0 AND now = 0 THEN 'went_dark'
    WHEN now - was >= 5 AND now - was >= was * 0.3 THEN 'ramp_up'
    WHEN was - now >= 5 AND was - now >= was * 0.3 AND now > 0 THEN 'ramp_down' END AS signal
  FROM (SELECT source, company, a.open AS was, b.open AS now
    FROM (FROM day_a WHERE source <> 'g3') a FULL JOIN day_b b USING (source, company)))
WHERE signal IS NOT NULL""",
        tuple(
            _EVENTS.format(name=n, first=f, last=t)
            for n, (f, t) in zip(("day_a", "day_b"), _DAYS, strict=True)
        ),
    )
)
def history_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (_event_day(spark, sf_dir, *days) for days in _DAYS)
    before = before.where("source <> 'g3'")  # a source the earlier snapshot did not cover
    return diff.day_signals(before, after, before)


@query(
    """
SELECT source, company, issue_date, open, prev_issue, open - prev_count AS delta FROM (
  SELECT *, lag(issue_date) OVER w AS prev_issue, lag(open) OVER w AS prev_count FROM (
    SELECT 'g' || (user_id % 4) AS source, 'u' || user_id AS company, CAST(ts AS DATE) AS issue_date,
      count(*) AS open FROM events GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY source, company ORDER BY issue_date))"""
)
def issue_to_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    issues = events.groupBy(
        F.concat(F.lit("g"), F.col("user_id") % 4).alias("source"),
        F.concat(F.lit("u"), "user_id").alias("company"),
        F.col("ts").cast("timestamp_ntz").cast("date").alias("issue_date"),
    ).agg(F.count("*").alias("open"))
    return diff.issue_to_issue(issues)
