"""Queries on scalar functions and filters, over titles and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions import text
from postpulse.operators import filters
from postpulse.operators.census import classified
from postpulse.plans import bindings as b
from postpulse.plans.boards import PARTS, STEMS, norm_sql, places_sql
from postpulse.plans.catalogue import query

_ROLES = ("roles",)
# What the facts of a title say; staff for volunteers are no volunteers.
_AD = "family = 'suspect_recruitment_ad'"
_VOL = "(family = 'volunteer_unpaid' AND stated <> 'Volunteer Services Manager')"


@query(
    b.with_ctes(
        _ROLES,
        f"SELECT pos, {norm_sql('title')} AS norm, seniority, {_AD} AS recruitment_ad, {_VOL} AS volunteer"
        " FROM roles JOIN role_facts USING (role)",
    )
)
def title_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.roles(spark, sf_dir).select(
        "pos",
        text.normal_title("title").alias("norm"),
        text.seniority("title").alias("seniority"),
        text.is_recruitment_ad("title").alias("recruitment_ad"),
        text.is_volunteer_listing("title").alias("volunteer"),
    )


@query(b.with_ctes(_ROLES, "SELECT pos, family FROM roles JOIN role_facts USING (role)"))
def title_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(b.roles(spark, sf_dir)).select("pos", "family")


@query(b.with_ctes(_ROLES, "SELECT pos, family, key, weak FROM roles JOIN role_facts USING (role)"))
def title_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(b.roles(spark, sf_dir)).select("pos", "family", "key", "weak")


@query(
    b.with_ctes(
        _ROLES,
        f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE {_AD}) AS recruitment_ads,
  count(*) FILTER (WHERE {_VOL}) AS volunteer_unpaid FROM roles JOIN role_facts USING (role)""",
    )
)
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.roles(spark, sf_dir).agg(*filters.rule_counts())


QUALITY = f"""quality AS (
  SELECT *, recruitment_ads + volunteer_unpaid AS not_jobs,
    (recruitment_ads + volunteer_unpaid) / titles_read AS not_jobs_share
  FROM (SELECT board, count(*) AS titles_read, count(*) FILTER (WHERE {_AD}) AS recruitment_ads,
    count(*) FILTER (WHERE {_VOL}) AS volunteer_unpaid FROM roles JOIN role_facts USING (role) GROUP BY 1))"""


@query(b.with_ctes(_ROLES, "SELECT * FROM quality", (QUALITY,)))
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exclusive_quality(b.roles(spark, sf_dir), ["board"])


@query(
    b.with_ctes(
        _ROLES,
        "SELECT * FROM quality WHERE not_jobs > 0 ORDER BY not_jobs_share DESC, not_jobs DESC, board LIMIT 10",
        (QUALITY,),
    )
)
def quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = filters.exclusive_quality(b.roles(spark, sf_dir), ["board"])
    return filters.worst_quality(quality, 10, "board")


def _of_documents(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Documents with ``place``, their turn among ``every`` literals."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("place", F.col("doc_id") % every)


# Place, stated workplace, and what it comes to.
WORKPLACES = [
    ("Berlin", None, "onsite"),
    ("Remote - US", None, "remote"),
    ("Hybrid remote", None, "hybrid"),
    ("New York (HQ)", "Hybrid", "hybrid"),
    ("anywhere", "OnSite", "onsite"),
    ("work from home", "unknown", "remote"),
    (None, "remote", "remote"),
    ("distributed team", None, "remote"),
    ("premote", None, "onsite"),
]


@query(
    b.with_ctes(
        (),
        f"SELECT doc_id, workplace FROM documents JOIN t ON place = doc_id % {len(WORKPLACES)}",
        (b.values_cte("t", ("place", "workplace"), [(k, w[2]) for k, w in enumerate(WORKPLACES)]),),
    )
)
def workplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of_documents(spark, sf_dir, len(WORKPLACES))
    place, stated = (b.pick(F.col("place"), [w[k] for w in WORKPLACES]) for k in (0, 1))
    # Whole documents stand before the place: their words name no way of working.
    label = F.concat_ws(" ; ", "text", place)
    return rows.select("doc_id", text.workplace(label, stated).alias("workplace"))


# What a text may end in, and the salary it states.
SALARIES = [
    ("Pay: $150,000 - $200,000 a year", 150_000, 200_000, "USD"),
    ("£70k–£90k", 70_000, 90_000, "GBP"),
    ("€80.000 - €100.000", 80_000, 100_000, "EUR"),
    ("C$100,000 to C$120,000", 100_000, 120_000, "CAD"),
    ("120000-160000 USD", None, None, None),
    ("$90k-$100k or $90,000 to $150,000", 90_000, 150_000, "USD"),
    ("1,000,000 to 2,000,000", 1_000_000, 2_000_000, None),
    ("500 to 900 people, 5,000 - 9,000", None, None, None),
    ("$120.5k - 140k", 120_500, 140_000, "USD"),
    ("$200,000 - $150,000", None, None, None),
    ("", None, None, None),
    ("A$80,000 — 95,000", 80_000, 95_000, "AUD"),
    ("10k-20k and £30k to £40k", 10_000, 20_000, None),
]


@query(
    b.with_ctes(
        (),
        f"""
SELECT doc_id, salary_min::BIGINT AS salary_min, salary_max::BIGINT AS salary_max, salary_currency
FROM documents JOIN t ON place = doc_id % {len(SALARIES)}""",
        (
            b.values_cte(
                "t",
                ("place", "salary_min", "salary_max", "salary_currency"),
                [(k, *r[1:]) for k, r in enumerate(SALARIES)],
            ),
        ),
    )
)
def salary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of_documents(spark, sf_dir, len(SALARIES))
    ending = b.pick(F.col("place"), [r[0] for r in SALARIES])
    body = F.concat_ws(" ; ", "text", ending)
    return rows.withColumn("s", text.salary(body)).select("doc_id", "s.*")


@query(
    b.with_ctes(
        ("titles",),
        f"""
SELECT board, stem, count(*) AS postings, count(DISTINCT tail) AS tails, count(DISTINCT norm) AS norms,
  count(DISTINCT array_to_string({places_sql('location')}, ' ')) AS places
FROM stemmed GROUP BY 1, 2""",
        (PARTS, STEMS),
    )
)
def stem_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.titles(spark, sf_dir).withColumn("parts", text.title_parts("title"))
    rows = parts.select(
        "board",
        text.stem_of("parts").alias("stem"),
        text.tail_of("parts").alias("tail"),
        text.normal_title("title").alias("norm"),
        text.normal_place("location").alias("place"),
    )
    return rows.groupBy("board", "stem").agg(
        F.count("*").alias("postings"),
        F.count_distinct("tail").alias("tails"),
        F.count_distinct("norm").alias("norms"),
        F.count_distinct("place").alias("places"),
    )


# First parts of paths and hosts that name no board, stated again so that a wrong list shows.
NO_BOARD = """'embed', 'api', 'v1', 'v0', 'jobs', 'job', 'static', 'assets', 'favicon.ico', 'robots.txt',
  'sitemap.xml', 'error', '404', 'index.html', 'apply', 'search', 'postings', 'boards', 'company',
  'companies', 'auth', 'login', 'signup', 'j', 'oauth', 'account', 'settings', 'terms', 'privacy',
  'www', 'app', 'help', 'support', 'blog', 'status', 'mail', 'cdn', 'static1', 'docs',
  'developer', 'developers', 'admin', 'dashboard', 'go', 'get', 'my'"""


@query(
    """
SELECT page_id, CASE WHEN token = '' OR length(token) > 100 OR token IN ("""
    + NO_BOARD
    + """) OR NOT regexp_full_match(token, '[a-z0-9][a-z0-9._-]*') OR regexp_full_match(token, '\\d+')
  THEN NULL ELSE token END AS path_token,
  CASE WHEN sub = '' OR contains(sub, '.') OR sub IN ("""
    + NO_BOARD
    + """) THEN NULL ELSE sub END AS host_token,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')/' AS surt
FROM (SELECT page_id, host, lower(regexp_extract(url, '^https?://[^/?#]+/+([^/?#]*)', 1)) AS token,
    CASE WHEN ends_with(host, '.example.com') THEN host[:length(host) - 12] ELSE '' END AS sub
  FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages))"""
)
def token_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return pages.select(
        "page_id",
        text.token_from_url("url").alias("path_token"),
        text.token_from_url("url", token_from="subdomain", host="example.com").alias("host_token"),
        text.surt_prefix(host).alias("surt"),
    )


@query(
    r"""
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
  '[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'),
  '^ | $', '', 'g') AS body FROM pages"""
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("body"))


# What a text may end in, the title it stands under, and the technologies that count.
MENTIONS = [
    ("Python and PySpark, java not javascript", "Data Engineer", "Python,JavaScript,Java"),
    ("React to change; swift decisions", "Store Manager", ""),
    ("React, Swift and Rust", "iOS Developer", "React,Rust,Swift"),
    ("see https://python.org or mail ruby@rails.io <b>php</b>", "Engineer", "PHP"),
    ("C++ / C# on .NET, Node.js, k8s", "Platform Architect", "Node.js,.NET,C#,C++,Kubernetes"),
    ("dbt and DBT; Power BI; LLMs", "analytics lead", "dbt,Power BI,LLM"),
    ("we use SAP and Salesforce", "Accountant", "Salesforce"),
    ("", None, ""),
    ("érust et ruby", "software", "Rust,Ruby"),
]


@query(
    b.with_ctes(
        (),
        f"SELECT doc_id, technologies FROM documents JOIN t ON place = doc_id % {len(MENTIONS)}",
        (b.values_cte("t", ("place", "technologies"), [(k, m[2]) for k, m in enumerate(MENTIONS)]),),
    )
)
def tech_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of_documents(spark, sf_dir, len(MENTIONS))
    ending, context = (b.pick(F.col("place"), [m[k] for m in MENTIONS]) for k in (0, 1))
    found = text.technologies(F.concat_ws(" ; ", "text", ending), context)
    return rows.select("doc_id", F.array_join(found, ",").alias("technologies"))


@query(
    """
SELECT page_id, replace(replace(replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages"""
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.escape_html("url").alias("escaped"))


@query(
    """
SELECT doc_id, lang, source FROM documents
WHERE (contains(lower(text), 'password') OR contains(lower(text), 'idiot') OR contains(lower(text), 'www'))
  AND contains(lower(source), 'src1') AND lang IN ('en', 'de')"""
)
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: text is the description, source the location, lang the workplace."""
    docs = b.table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("department"),
        F.lit(None).cast("string").alias("team"),
        F.col("text").alias("description"),
        F.col("source").alias("location"),
        F.col("lang").alias("workplace"),
    )
    wanted = filters.PostingFilter(
        keywords=("password", "idiot", "www"), location="src1", workplaces=("en", "de")
    )
    return rows.where(wanted.condition()).select("doc_id", "lang", "source")


@query(
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  floor(value / 7 * 100 + 0.5) / 100 AS scaled FROM events"""
)
def json_and_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        text.round_half_up(F.col("value") / 7, 2).alias("scaled"),
    )
