"""Queries on boards: signals, top lists, repeats and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.text import seniority
from postpulse.operators import dedupe, fanout, signals
from postpulse.operators.staging import staged
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query

# Words that are no place, stated again so that a wrong list shows.
NOISE = """'remote', 'hybrid', 'onsite', 'on', 'site', 'usa', 'us', 'united', 'states', 'america', 'or',
  'and', 'the', 'of', 'in', 'at', 'area', 'greater', 'metro', 'region', 'multiple', 'locations',
  'location', 'various', 'flexible', 'anywhere', 'office', 'based'"""


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


def places_sql(text: str) -> str:
    words = f"string_split({norm_sql(text)}, ' ')"
    return f"list_sort(list_distinct(list_filter({words}, lambda w: w <> '' AND w NOT IN ({NOISE}))))"


SIGNALS = """
SELECT source, company,
  CASE WHEN postings_dated = 0 THEN 'undated'
    WHEN oldest > TIMESTAMP '{as_of}' - INTERVAL 60 DAY THEN 'new_board'
    WHEN opened_30d >= 3 AND (ramp_ratio IS NULL OR ramp_ratio >= 2) THEN 'ramping'
    WHEN opened_30d >= 1 THEN 'steady' ELSE 'quiet' END AS signal,
  open_postings, postings_dated, opened_7d, opened_30d, opened_90d, baseline_30d, ramp_ratio,
  CAST(oldest AS DATE) AS oldest_posting, CAST(newest AS DATE) AS newest_posting
FROM (SELECT *, prior / 2.0::DOUBLE AS baseline_30d,
    CASE WHEN prior > 0 THEN floor(opened_30d / (prior / 2.0::DOUBLE) * 100 + 0.5) / 100 END AS ramp_ratio
  FROM (SELECT source, company, count(*) AS open_postings, count(posted_at) AS postings_dated,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '{as_of}' - INTERVAL 7 DAY AND posted_at <= TIMESTAMP '{as_of}') AS opened_7d,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '{as_of}' - INTERVAL 30 DAY AND posted_at <= TIMESTAMP '{as_of}') AS opened_30d,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '{as_of}' - INTERVAL 90 DAY AND posted_at <= TIMESTAMP '{as_of}') AS opened_90d,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '{as_of}' - INTERVAL 90 DAY AND posted_at <= TIMESTAMP '{as_of}' - INTERVAL 30 DAY) AS prior,
      min(posted_at) AS oldest, max(posted_at) AS newest
    FROM postings GROUP BY 1, 2))"""


def board_signals(spark: SparkSession, sf_dir: str, as_of: str = b.AS_OF) -> DataFrame:
    found = signals.company_signal(b.postings(spark, sf_dir), as_of)
    return found.withColumns(
        {
            "oldest_posting": F.col("oldest_posting_at").cast("date"),
            "newest_posting": F.col("newest_posting_at").cast("date"),
        }
    ).drop("oldest_posting_at", "newest_posting_at")


@query(b.with_ctes(("postings",), SIGNALS.format(as_of=b.AS_OF)))
def company_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board_signals(spark, sf_dir)


# Departments here: priority and status, the latest status of each board's late orders.
_LATE = "CASE WHEN posted_at > TIMESTAMP '1995-04-01' THEN department || ' ' || status ELSE department END"


@query(
    b.with_ctes(
        ("postings",),
        f"""
SELECT source, company, CAST(rank AS INTEGER) AS rank, name, count FROM (
  SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY count DESC, name) AS rank FROM (
    SELECT *, sum(count) OVER w AS history, min(oldest) OVER w AS first, count(name) OVER w AS departments
    FROM (SELECT source, company,
        CASE WHEN name <> '' AND NOT regexp_matches(name, ',\\s*(?:[A-Z]{{2}}|[A-Z][a-z]+)\\s*$|\\b(?:remote|onsite|hybrid)\\b') THEN name END AS name,
        count(*) AS count, min(posted_at) AS oldest
      FROM (SELECT source, company, posted_at, {_LATE} AS name FROM postings WHERE posted_at IS NOT NULL) GROUP BY ALL)
    WINDOW w AS (PARTITION BY source, company))
  WHERE history >= 5 AND first <= TIMESTAMP '1995-03-17' AND departments <= 25 AND name IS NOT NULL
    AND oldest > TIMESTAMP '1995-03-17' AND count >= 2) WHERE rank <= 5""",
    )
)
def signal_new_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("posted_at") > F.lit("1995-04-01").cast("timestamp_ntz")
    name = F.when(late, F.concat_ws(" ", "department", "status")).otherwise(F.col("department"))
    rows = b.postings(spark, sf_dir).withColumn("department", name)
    return signals.new_functions(rows, b.AS_OF)


@query(
    b.with_ctes(
        ("postings",),
        """
SELECT source, company, CAST(rank AS INTEGER) AS rank, name, count FROM (
  SELECT source, company, department AS name, count(*) AS count,
    row_number() OVER (PARTITION BY source, company ORDER BY count(*) DESC, department) AS rank
  FROM postings WHERE department <> '' GROUP BY 1, 2, 3) WHERE rank <= 3""",
    )
)
def signal_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.top_counts(b.postings(spark, sf_dir), "department", 3)


@query(
    b.with_ctes(
        ("mentions",),
        """
SELECT source, company, technology, count(*) AS count FROM mentions
WHERE posted_at > TIMESTAMP '1997-06-01' - INTERVAL 90 DAY GROUP BY 1, 2, 3""",
    )
)
def signal_tech_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.mentions(spark, sf_dir)
    return signals.technology_counts(rows, F.array("technology"), b.LATER_AS_OF)


NORMED = (
    f"normed AS (SELECT *, {norm_sql('title')} AS norm_title,"
    f" array_to_string({places_sql('location')}, ' ') AS norm_place FROM titles)"
)


@query(
    b.with_ctes(
        ("titles",),
        """
SELECT board, norm_title, norm_place, min(pos) AS pos, count(*) - 1 AS duplicates_merged
FROM normed WHERE norm_title <> '' AND norm_place <> '' GROUP BY 1, 2, 3
UNION ALL SELECT board, norm_title, norm_place, pos, 0 FROM normed
WHERE NOT (norm_title <> '' AND norm_place <> '')""",
        (NORMED,),
    )
)
def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe.dedupe_rows(b.titles(spark, sf_dir))
    return found.select("board", "norm_title", "norm_place", "pos", "duplicates_merged")


REPEATS = """repeats AS (
  SELECT board, norm_title, copies, copies - 1 AS extra, stated - places AS same_location,
    greatest(places - 1, 0) AS distinct_location,
    CASE WHEN places > 0 THEN copies - stated ELSE greatest(copies - stated - 1, 0) END AS unstated
  FROM (SELECT board, norm_title, count(*) AS copies,
      count(*) FILTER (WHERE norm_place <> '') AS stated,
      count(DISTINCT CASE WHEN norm_place <> '' THEN norm_place END) AS places
    FROM normed WHERE norm_title <> '' GROUP BY 1, 2) WHERE copies > 1)"""


@query(b.with_ctes(("titles",), "SELECT * FROM repeats", (NORMED, REPEATS)))
def repeats_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.repeats_by_title(b.titles(spark, sf_dir))


@query(
    b.with_ctes(
        ("titles",),
        """
SELECT t.board, t.postings, coalesce(r.repeated_titles, 0) AS repeated_titles,
  coalesce(r.repeated_extra, 0)::BIGINT AS repeated_extra,
  coalesce(r.same_location_extra, 0)::BIGINT AS same_location_extra,
  coalesce(r.distinct_location_extra, 0)::BIGINT AS distinct_location_extra,
  coalesce(r.unstated_extra, 0)::BIGINT AS unstated_extra
FROM (SELECT board, count(*) AS postings FROM normed WHERE norm_title <> '' GROUP BY 1) t
LEFT JOIN (SELECT board, count(*) AS repeated_titles, sum(extra) AS repeated_extra,
    sum(same_location) AS same_location_extra, sum(distinct_location) AS distinct_location_extra,
    sum(unstated) AS unstated_extra FROM repeats GROUP BY 1) r USING (board)""",
        (NORMED, REPEATS),
    )
)
def analyse_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.analyse_boards(b.titles(spark, sf_dir))


@query(
    b.with_ctes(
        ("titles",),
        """
SELECT *, floor(repeated_extra / postings * 10000 + 0.5) / 10000 AS repeated_rate,
  floor(same_location_extra / postings * 10000 + 0.5) / 10000 AS same_location_rate,
  floor(distinct_location_extra / postings * 10000 + 0.5) / 10000 AS distinct_location_rate,
  floor(unstated_extra / postings * 10000 + 0.5) / 10000 AS unstated_rate
FROM (SELECT count(*) AS boards, sum(t.postings)::BIGINT AS postings, sum(r.repeated_titles)::BIGINT AS repeated_titles,
    sum(r.extra)::BIGINT AS repeated_extra, sum(r.same_location)::BIGINT AS same_location_extra,
    sum(r.distinct_location)::BIGINT AS distinct_location_extra, sum(r.unstated)::BIGINT AS unstated_extra
  FROM (SELECT board, count(*) AS postings FROM normed WHERE norm_title <> '' GROUP BY 1
      HAVING count(*) > count(DISTINCT norm_title)
      ORDER BY count(*) - count(DISTINCT norm_title) DESC, board LIMIT 12) t
  JOIN (SELECT board, count(*) AS repeated_titles, sum(extra) AS extra, sum(same_location) AS same_location,
      sum(distinct_location) AS distinct_location, sum(unstated) AS unstated FROM repeats GROUP BY 1) r USING (board))""",
        (NORMED, REPEATS),
    )
)
def repeat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.repeat_totals(b.titles(spark, sf_dir), 12)


@query(
    b.with_ctes(
        ("titles",),
        """
SELECT board, count(*) AS postings, count(*) - count(DISTINCT norm_title) AS repeats
FROM normed WHERE norm_title <> '' GROUP BY 1
HAVING repeats > 0 ORDER BY repeats DESC, board LIMIT 12""",
        (NORMED,),
    )
)
def repeat_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.rank_by_repeats(b.titles(spark, sf_dir), 12)


PARTS = (
    "parts AS (SELECT *, list_filter(list_transform("
    r"string_split(regexp_replace(title, '\s+[-–—|(]\s*|\s*,\s*', chr(1), 'g'), chr(1)),"
    f" lambda p: {norm_sql('p')}), lambda p: p <> '') AS p FROM titles)"
)
STEMS = (
    "stemmed AS (SELECT *, CASE WHEN len(p) > 1 THEN p[1] END AS stem,"
    " CASE WHEN len(p) > 1 THEN array_to_string(p[2:], ' ') END AS tail,"
    f" {norm_sql('title')} AS norm FROM parts)"
)
FANOUT = """fanout AS (
  SELECT board, stem, count(DISTINCT norm) AS titles, count(*) AS postings
  FROM stemmed WHERE stem <> norm GROUP BY 1, 2 HAVING count(DISTINCT norm) >= 5)"""


@query(b.with_ctes(("titles",), "SELECT * FROM fanout", (PARTS, STEMS, FANOUT)))
def fanout_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.fanout_stems(fanout.split_titles(b.titles(spark, sf_dir)))


@query(
    b.with_ctes(
        ("titles",),
        "SELECT board, count(*) AS stems, sum(postings)::BIGINT AS fanout_postings FROM fanout GROUP BY 1",
        (PARTS, STEMS, FANOUT),
    )
)
def fanout_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.fanout_boards(fanout.split_titles(b.titles(spark, sf_dir)))


SUPPORT = f"""support AS (
  SELECT token, count(DISTINCT CASE WHEN kind = 'p' THEN board END) AS in_places,
    count(DISTINCT CASE WHEN kind = 't' THEN board END) AS in_titles
  FROM (SELECT board, 'p' AS kind, unnest({places_sql('location')}) AS token FROM stemmed
    UNION ALL SELECT board, 't', unnest({places_sql('tail')}) FROM stemmed) GROUP BY 1)"""
GAZETTEER = "gaz AS (SELECT * FROM support WHERE in_places >= 3 AND in_places >= in_titles)"
_GEO = (PARTS, STEMS, FANOUT, SUPPORT, GAZETTEER)


@query(b.with_ctes(("titles",), "SELECT token, in_places, in_titles FROM gaz", _GEO))
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.gazetteer(fanout.token_support(fanout.split_titles(b.titles(spark, sf_dir))))


# Parts by size as boards: brands stand in the field, types in titles, and the
# smaller brands in the titles of every board but in the field of few.
DISPUTED = """support AS (
  SELECT token, count(DISTINCT CASE WHEN kind = 'p' THEN board END) AS in_places,
    count(DISTINCT CASE WHEN kind = 't' THEN board END) AS in_titles
  FROM (SELECT p_size AS board, 'p' AS kind,
      CASE WHEN p_size <= 8 THEN 'town' || substr(p_brand, 7) ELSE 'city' || substr(p_brand, 7) END AS token
    FROM part UNION ALL SELECT p_size, 't', 'town' || substr(p_brand, 7) FROM part
    UNION ALL SELECT p_size, 't', 'city' || substr(p_brand, 7) FROM part WHERE p_size % 2 = 0) GROUP BY 1)"""


def _disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 9)
    town, city = F.concat(F.lit("Town"), number), F.concat(F.lit("City"), number)
    title = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" - ", F.lit("Cook"), town, city))
    rows = b.table(spark, sf_dir, "part").select(
        F.concat(F.lit("b"), "p_size").alias("board"),
        title.otherwise(F.concat_ws(" - ", F.lit("Cook"), town)).alias("title"),
        F.when(F.col("p_size") <= 8, town).otherwise(city).alias("location"),
    )
    return fanout.token_support(fanout.split_titles(rows))


@query(
    b.with_ctes(
        (),
        "SELECT * FROM support WHERE in_places >= 3 AND in_places < in_titles",
        (DISPUTED,),
    )
)
def gazetteer_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.rejected_tokens(_disputed(spark, sf_dir))


@query(
    b.with_ctes(
        (),
        """
SELECT *, (SELECT list(token ORDER BY in_titles DESC, in_places DESC, token)[:20] FROM support
    WHERE in_places >= 3 AND in_places >= in_titles AND in_titles > 0) AS disputed_words,
  (SELECT list(token ORDER BY in_titles DESC, in_places DESC, token)[:20] FROM support
    WHERE in_places >= 3 AND in_places < in_titles) AS rejected_words
FROM (SELECT count(*) FILTER (WHERE in_places >= 3) AS loose,
    count(*) FILTER (WHERE in_places >= 3 AND in_places >= in_titles) AS tight,
    count(*) FILTER (WHERE in_places >= 3 AND in_places >= in_titles AND in_titles > 0) AS disputed,
    count(*) FILTER (WHERE in_places >= 3 AND in_places < in_titles) AS rejected,
    floor(count(*) FILTER (WHERE in_places >= 3 AND in_places >= in_titles)
      / count(*) FILTER (WHERE in_places >= 3) * 10000 + 0.5) / 10000 AS recall FROM support)""",
        (DISPUTED,),
    )
)
def gazetteer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.gazetteer_comparison(_disputed(spark, sf_dir))


VERIFIED = f"""verified AS (
  SELECT s.board, s.stem, s.pos,
    CASE WHEN len({places_sql('s.tail')}) = 0 THEN 'uninformative'
      WHEN len({places_sql('s.location')}) = 0 THEN 'unstated'
      WHEN list_has_any({places_sql('s.tail')}, {places_sql('s.location')}) THEN 'geographic'
      ELSE 'not_geographic' END AS verdict,
    list_has_any({places_sql('s.tail')}, coalesce((SELECT list(token) FROM gaz), [])) AS known
  FROM stemmed s JOIN fanout f USING (board, stem))"""
VERDICTS = """verdicts AS (
  SELECT board, stem, count(*) AS postings,
    count(*) FILTER (WHERE verdict = 'geographic') AS geographic,
    count(*) FILTER (WHERE verdict = 'not_geographic') AS not_geographic,
    count(*) FILTER (WHERE verdict = 'unstated') AS unstated,
    count(*) FILTER (WHERE verdict = 'uninformative') AS uninformative,
    count(*) FILTER (WHERE verdict = 'geographic' AND known) AS known_geographic,
    count(*) FILTER (WHERE verdict = 'not_geographic' AND known) AS known_not_geographic,
    count(*) FILTER (WHERE verdict = 'unstated' AND known) AS known_unstated,
    CASE WHEN count(*) FILTER (WHERE verdict IN ('geographic', 'not_geographic')) = 0 THEN 'undecidable'
      WHEN 2 * count(*) FILTER (WHERE verdict = 'geographic')
        >= count(*) FILTER (WHERE verdict IN ('geographic', 'not_geographic')) THEN 'geographic'
      ELSE 'not_geographic' END AS stem_verdict
  FROM verified GROUP BY 1, 2)"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = staged(fanout.split_titles(b.titles(spark, sf_dir)))
    places = fanout.gazetteer(fanout.token_support(split))
    return fanout.stem_verdicts(fanout.verified_rows(split, places))


@query(
    b.with_ctes(
        ("titles",),
        f"""
SELECT tail, hit FROM (SELECT tail, hit, row_number() OVER (PARTITION BY tail ORDER BY turn) AS n
  FROM (SELECT DISTINCT tail, unnest(string_split(tail, ' ')) AS hit,
      unnest(range(1, len(string_split(tail, ' ')) + 1)) AS turn FROM stemmed WHERE tail IS NOT NULL)
  WHERE hit IN (SELECT token FROM gaz)) WHERE n = 1""",
        _GEO,
    )
)
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = staged(fanout.split_titles(b.titles(spark, sf_dir)))
    return fanout.first_known_place(split, fanout.gazetteer(fanout.token_support(split)))


@query(b.with_ctes(("titles",), "SELECT * FROM verdicts", (*_GEO, VERIFIED, VERDICTS)))
def fanout_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stems(spark, sf_dir)


@query(
    b.with_ctes(
        ("titles",),
        """
SELECT board, sum(postings)::BIGINT AS postings, sum(geographic)::BIGINT AS geographic,
  sum(not_geographic)::BIGINT AS not_geographic, sum(unstated)::BIGINT AS unstated,
  sum(uninformative)::BIGINT AS uninformative, sum(known_geographic)::BIGINT AS known_geographic,
  sum(known_not_geographic)::BIGINT AS known_not_geographic, sum(known_unstated)::BIGINT AS known_unstated,
  count(*) FILTER (WHERE stem_verdict = 'geographic') AS stems_geographic,
  count(*) FILTER (WHERE stem_verdict = 'not_geographic') AS stems_not_geographic,
  count(*) FILTER (WHERE stem_verdict = 'undecidable') AS stems_undecidable,
  sum(geographic)::BIGINT AS lower,
  sum(geographic + known_not_geographic + known_unstated)::BIGINT AS upper
FROM verdicts GROUP BY 1""",
        (*_GEO, VERIFIED, VERDICTS),
    )
)
def fanout_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.fanout_bounds(_stems(spark, sf_dir))


# Postings with titles, texts and pay: what a whole record is made of.
BODIES = (
    ("", ""),
    ("We run Kubernetes, Kafka and Java.", "Java,Kubernetes,Kafka"),
    ("Java and Java again, Terraform too.", "Java,Terraform"),
    ("No tools at all.", ""),
)
FULL = (
    "full_postings AS (SELECT p.*, r.stated AS title, r.seniority, x.technologies,"
    " CASE WHEN o_orderkey % 4 = 1 THEN 'remote' ELSE 'onsite' END AS workplace,"
    " CASE WHEN o_totalprice > 200000 THEN 1 END AS salary_min"
    " FROM postings p JOIN orders ON o_orderkey = p.pos JOIN role_facts r ON r.role = p.pos % 54"
    " JOIN bodies x ON x.place = p.pos % 4)"
)
_BODIES = b.values_cte("bodies", ("place", "technologies"), [(k, x[1]) for k, x in enumerate(BODIES)])


def full_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("pos")
    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_k"), F.when(F.col("o_totalprice") > 200_000, 1).alias("salary_min")
    )
    title = b.pick(key % len(b.ROLES), [r[0] for r in b.ROLES])
    return b.postings(spark, sf_dir).join(orders, key == F.col("_k")).withColumns(
        {
            "title": title,
            "seniority": seniority(title),
            "team": F.lit(None).cast("string"),
            "description": b.pick(key % len(BODIES), [x[0] for x in BODIES]),
            "workplace": F.when(key % 4 == 1, "remote").otherwise("onsite"),
        }
    )


def _listed(name: str) -> F.Column:
    pair = F.transform(name, lambda i: F.concat(i["name"], F.lit(":"), i["count"]))
    return F.array_join(pair, ",").alias(name)


def _top_sql(value: str, most: int) -> str:
    """name:count of a board's commonest values, as one string."""
    return f"""(SELECT source, company, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS items FROM (
      SELECT source, company, {value} AS name, count(*) AS n,
        row_number() OVER (PARTITION BY source, company ORDER BY count(*) DESC, {value}) AS place
      FROM full_postings WHERE {value} <> '' GROUP BY 1, 2, 3) WHERE place <= {most} GROUP BY 1, 2)"""


RECORD = f"""record AS (
  SELECT s.*, e.executive_openings_90d, e.remote_postings, e.postings_with_salary,
    coalesce(d.items, '') AS top_departments, coalesce(t.items, '') AS top_titles,
    coalesce(k.items, '') AS tech_signals
  FROM ({SIGNALS.format(as_of=b.AS_OF)}) s
  JOIN (SELECT source, company,
      count(*) FILTER (WHERE seniority = 'executive' AND posted_at > TIMESTAMP '{b.AS_OF}' - INTERVAL 90 DAY) AS executive_openings_90d,
      count(*) FILTER (WHERE workplace = 'remote') AS remote_postings, count(salary_min) AS postings_with_salary
    FROM full_postings GROUP BY 1, 2) e USING (source, company)
  LEFT JOIN {_top_sql('department', 5)} d USING (source, company)
  LEFT JOIN {_top_sql('title', 5)} t USING (source, company)
  LEFT JOIN (SELECT source, company, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS items FROM (
      SELECT source, company, name, count(*) AS n,
        row_number() OVER (PARTITION BY source, company ORDER BY count(*) DESC, name) AS place
      FROM (SELECT DISTINCT source, company, pos, unnest(list_concat(
            CASE WHEN technologies = '' THEN []::VARCHAR[] ELSE string_split(technologies, ',') END,
            CASE WHEN title = 'Python Developer' THEN ['Python'] ELSE []::VARCHAR[] END)) AS name
          FROM full_postings WHERE posted_at > TIMESTAMP '{b.AS_OF}' - INTERVAL 90 DAY)
      GROUP BY 1, 2, 3) WHERE place <= 12 GROUP BY 1, 2) k USING (source, company))"""
_RECORD = (_BODIES, FULL, RECORD)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.signal_records(full_postings(spark, sf_dir), b.AS_OF, use_description=True)
    return found.select(
        "source", "company", "signal", "open_postings", "postings_dated", "opened_7d", "opened_30d",
        "opened_90d", "baseline_30d", "ramp_ratio",
        F.col("oldest_posting_at").cast("date").alias("oldest_posting"),
        F.col("newest_posting_at").cast("date").alias("newest_posting"),
        "executive_openings_90d", "remote_postings", "postings_with_salary",
        *[_listed(c) for c in ("top_departments", "top_titles", "tech_signals")],
    )


@query(b.with_ctes(("postings", "role_facts"), "SELECT * FROM record", _RECORD))
def signal_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@query(
    b.with_ctes(
        ("postings", "role_facts"),
        "SELECT * FROM record WHERE open_postings >= 100 AND signal IN ('steady', 'ramping')",
        _RECORD,
    )
)
def signals_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.delivered(_records(spark, sf_dir), ("steady", "ramping"), 100)


@query(
    b.with_ctes(
        ("postings", "role_facts"),
        f"""
SELECT source, company, count(*) AS technologies, sum(n)::BIGINT AS mentions FROM (
  SELECT source, company, 'Python' AS name, count(*) AS n FROM full_postings
  WHERE title = 'Python Developer' AND posted_at > TIMESTAMP '{b.AS_OF}' - INTERVAL 90 DAY GROUP BY ALL)
GROUP BY 1, 2""",
        (_BODIES, FULL),
    )
)
def signal_titles_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without descriptions technologies come from titles, teams and departments alone."""
    found = signals.signal_records(full_postings(spark, sf_dir), b.AS_OF)
    rows = found.select("source", "company", F.explode("tech_signals").alias("t"))
    return rows.groupBy("source", "company").agg(
        F.count("*").alias("technologies"), F.sum("t.count").alias("mentions")
    )


@query(
    b.with_ctes(
        ("postings",),
        f"""
SELECT source, company, signal, open_postings, CAST(place AS INTEGER) AS place,
  floor(postings_dated * 100.0::DOUBLE / open_postings * 10 + 0.5) / 10 AS dated_pct
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY open_postings DESC, company) AS place
  FROM ({SIGNALS.format(as_of=b.AS_OF)})) WHERE place <= 15""",
    )
)
def signal_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.preview(b.postings(spark, sf_dir), b.AS_OF, 15)
    return found.select("source", "company", "signal", "open_postings", "place", "dated_pct")


@query(
    """
SELECT c_mktsegment || ' ' || o_orderstatus AS name, count(*) AS postings
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 3 GROUP BY 1"""
)
def department_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as departments; every fifth order each has a numbered one, a place or none."""
    key, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    number = F.lpad((key % 10_000).cast("string"), 4, "0")
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = b.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    department = (
        F.when(key % 5 == 0, F.concat(segment, F.lit(" - "), number))
        .when(key % 5 == 1, F.concat(number, F.lit(" - "), segment))
        .when(key % 5 == 2, F.concat(F.initcap(segment), F.lit(", DE")))
        .when(key % 5 == 3, F.concat_ws(" ", segment, "o_orderstatus"))
    )
    rows = orders.select(department.alias("department"))
    real = signals.real_departments(rows)
    return real.groupBy(F.col("department").alias("name")).agg(F.count("*").alias("postings"))
