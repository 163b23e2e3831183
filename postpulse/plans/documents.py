"""Queries on raw documents: vendor bodies and robots files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators.robots import robots_verdicts
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query
from postpulse.sources.vendors import all_postings, by_source

# Invented boards in each vendor's shape, for tests.
BODIES = [
    (
        "greenhouse",
        "acme",
        '{"jobs": [{"id": 1, "title": " Senior Engineer ", "absolute_url": "https://x.example/1",'
        ' "location": {"name": "Remote, US"}, "departments": [{"name": "R&D"}],'
        ' "first_published": "2026-08-01T10:00:00+02:00", "updated_at": "2026-08-02",'
        ' "content": "%3Cp%3EPay $150,000 - $200,000%3C/p%3E"}]}',
    ),
    (
        "ashby",
        "beta",
        '{"jobs": [{"id": "a1", "title": "Analyst", "jobUrl": "https://x.example/a1", "location": "Berlin",'
        ' "workplaceType": "Hybrid", "publishedAt": "2026-07-30",'
        ' "compensation": {"compensationTierSummary": "£70k–£90k"}, "descriptionPlain": "Numbers"}]}',
    ),
    (
        "lever",
        "gamma",
        '[{"id": "l1", "text": "Head of Sales", "hostedUrl": "https://x.example/l1", "createdAt": 1754000000000,'
        ' "categories": {"location": "", "team": "Field"}, "workplaceType": "remote", "description": "<b>Sell</b>"}]',
    ),
    (
        "workable",
        "delta",
        '{"jobs": [{"title": "Driver", "shortcode": "W1", "telecommuting": true, "city": "Leeds", "state": " ",'
        ' "country": "UK", "published_on": "2026-06-01", "description": "Drive"}]}',
    ),
    (
        "breezy",
        "epsilon",
        '[{"friendly_id": "b1", "name": "Nurse", "published_date": "2026-05-01T00:00:00Z",'
        ' "location": {"city": "Oslo", "country": {"name": "Norway"}}, "salary": "€80.000 - €100.000"}]',
    ),
    (
        "recruitee",
        "zeta",
        '{"offers": [{"id": 7, "title": "Cook", "city": "Gent", "country_code": "BE",'
        ' "published_at": "2026-08-05 08:02:41 UTC",'
        ' "salary": {"min": "30,000", "max": "35000", "period": "year", "currency": "EUR"}}]}',
    ),
    (
        "teamtailor",
        "eta",
        '{"items": [{"id": "t1", "title": "Junior Chef", "url": "https://x.example/t1",'
        ' "date_published": "2026-04-04T12:00:00+02:00", "content_html": "<p>Hot &amp; busy</p>",'
        ' "_jobposting": {"department": "Kitchen", "jobLocation": [{"address": {"addressLocality": "Lund",'
        ' "addressCountry": "SE"}}]}}]}',
    ),
    ("lever", "broken", '{"error": "not found"}'),
]

ROBOTS = [
    None,
    "User-agent: *\nDisallow: /fr",
    "User-agent: botty\nDisallow: /\n\nUser-agent: *\nDisallow:",
    "User-agent: other\nUser-agent: *\nDisallow: /*?page=",
    "User-agent: other\nDisallow: /",
    "User-agent: *\nDisallow: /en\nAllow: /en/2",
]


@query(
    b.with_ctes(
        (),
        r"""
SELECT page_id, rule IS NULL OR starts_with(rule, '/en/2') AS allowed,
  CASE WHEN file = 0 THEN 'no file' WHEN file = 4 THEN 'no group' WHEN rule IS NULL THEN 'no rule'
    WHEN rule = '/en/2' THEN 'allow' ELSE 'disallow' END AS reason, rule
FROM (SELECT page_id, file, CASE WHEN file = 1 AND starts_with(path, '/fr') THEN '/fr' WHEN file = 2 THEN '/'
    WHEN file = 3 AND contains(path, '?page=') THEN '/*?page='
    WHEN file = 5 AND starts_with(path, '/en/2') THEN '/en/2'
    WHEN file = 5 AND starts_with(path, '/en') THEN '/en' END AS rule
  FROM (SELECT page_id, page_id % 6 AS file, regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1) AS path FROM pages))""",
    )
)
def robots_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^#]*)", 1)
    rows = b.table(spark, sf_dir, "pages").select(
        "page_id", b.pick(F.col("page_id") % len(ROBOTS), ROBOTS).alias("robots"), path.alias("path")
    )
    return robots_verdicts(rows, "botty/1.0").select("page_id", "allowed", "reason", "rule")


#: The vendors in the order that customers are dealt to them.
DEALT = ["greenhouse", "ashby", "lever", "workable", "breezy", "recruitee", "teamtailor"]


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a board of one of seven vendors, in the JSON that it serves."""
    key = F.col("o_orderkey")
    paid = key % 3 == 0
    orders = b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), F.col("o_custkey")).alias("company"),
        (F.col("o_custkey") % 7).alias("vendor"),
        key.alias("id"),
        b.pick(key % len(b.ROLES), [r[0] for r in b.ROLES]).alias("title"),
        F.concat(F.lit("City"), key % 25).alias("city"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.unix_timestamp("o_orderdate") * 1000).alias("ms"),
        F.col("o_orderpriority").alias("dept"),
        F.when(paid, "Pay $150,000 - $200,000").otherwise("<p>Fair &amp; square</p>").alias("text"),
        b.pick(key % 3, ["Hybrid", None, "Remote"]).alias("kind"),
        F.when(paid, "$150,000 - $200,000").alias("pay"),
        F.when(key % 4 == 0, "Town").when(key % 4 == 1, "").alias("place"),
    )
    url = F.concat(F.lit("https://x.example/"), "id")

    def named(mark: str):
        return F.concat(F.lit(mark), "id").alias("id")

    def struct(name: str, *fields) -> F.Column:
        return F.struct(*fields).alias(name)

    title, dept, city, text = (F.col(c) for c in ("title", "dept", "city", "text"))
    oz = F.lit("Oz").alias("name"), F.lit("OZ")
    jobs = {
        "greenhouse": F.struct(
            "id", "title", url.alias("absolute_url"), struct("location", city.alias("name")),
            F.array(F.struct(dept.alias("name"))).alias("departments"),
            F.col("day").alias("first_published"), text.alias("content"),
        ),
        "ashby": F.struct(
            named("a"), "title", url.alias("jobUrl"), city.alias("location"), F.col("kind").alias("workplaceType"),
            F.col("day").alias("publishedAt"), dept.alias("department"), text.alias("descriptionHtml"),
        ),
        "lever": F.struct(
            named("l"), title.alias("text"), url.alias("hostedUrl"), F.col("ms").alias("createdAt"),
            text.alias("description"), struct("categories", F.lit("").alias("location"), dept.alias("team")),
        ),
        "workable": F.struct(
            F.concat(F.lit("w"), "id").alias("shortcode"), F.lit("unused").alias("id"), "title",
            (F.col("kind") == "Remote").alias("telecommuting"), dept.alias("department"),
            url.alias("shortlink"), F.col("day").alias("published_on"), F.lit("Oz").alias("country"),
            city.alias("city"), F.lit(" ").alias("state"), text.alias("description"),
        ),
        "breezy": F.struct(
            named("z"), title.alias("name"), url.alias("url"), F.col("day").alias("published_date"),
            dept.alias("department"), F.col("pay").alias("salary"),
            struct("location", F.col("place").alias("name"), city.alias("city"), struct("country", oz[0])),
        ),
        "recruitee": F.struct(
            named("r"), "title", dept.alias("department"), F.col("day").alias("published_at"), city.alias("city"),
            oz[1].alias("country_code"), url.alias("careers_url"), text.alias("description"),
            F.when(
                F.col("pay").isNotNull(),
                F.struct(
                    F.lit("149,999.5").alias("min"), F.lit("200 000").alias("max"),
                    F.when(F.col("id") % 2 == 0, "year").otherwise("month").alias("period"),
                    F.lit("EUR").alias("currency"),
                ),
            ).alias("salary"),
        ),
        "teamtailor": F.struct(
            named("t"), "title", url.alias("url"), text.alias("content_html"),
            struct(
                "_jobposting", F.col("day").alias("datePosted"), dept.alias("department"),
                F.array(
                    F.struct(struct("address", city.alias("addressLocality"), oz[1].alias("addressCountry")))
                ).alias("jobLocation"),
            ),
        ),
    }
    one = b.pick(F.col("vendor"), [None] * len(DEALT))
    for n, name in enumerate(DEALT):
        one = F.when(F.col("vendor") == n, F.to_json(jobs[name])).otherwise(one)
    boards = orders.select("vendor", "company", one.alias("job")).groupBy("vendor", "company")
    listed = boards.agg(F.concat(F.lit("["), F.array_join(F.collect_list("job"), ","), F.lit("]")).alias("jobs"))
    listing = b.pick(F.col("vendor"), ["jobs", "jobs", None, "jobs", None, "offers", "items"])
    wrapped = F.concat(F.lit('{"'), listing, F.lit('": '), "jobs", F.lit("}"))
    return listed.select(
        b.pick(F.col("vendor"), DEALT).alias("source"), "company", F.coalesce(wrapped, "jobs").alias("body")
    )


@query(
    b.with_ctes(
        ("role_facts",),
        """
SELECT source, company, ['', 'a', 'l', 'w', 'z', 'r', 't'][vendor + 1] || o_orderkey AS job_id,
  coalesce(stated, '') AS title, 'https://x.example/' || o_orderkey AS url,
  CASE WHEN vendor < 2 THEN city WHEN vendor = 2 OR (vendor = 4 AND o_orderkey % 4 = 1) THEN NULL
    WHEN vendor = 4 AND o_orderkey % 4 = 0 THEN 'Town' WHEN vendor IN (3, 4) THEN city || ', Oz'
    ELSE city || ', OZ' END AS location,
  CASE WHEN vendor = 1 AND o_orderkey % 3 = 0 THEN 'hybrid' WHEN vendor IN (1, 3) AND o_orderkey % 3 = 2 THEN 'remote'
    WHEN vendor NOT IN (1, 2) AND stated = 'Work From Home Opportunity' THEN 'remote' ELSE 'onsite' END AS workplace,
  CASE WHEN vendor <> 2 THEN o_orderpriority END AS department,
  CASE WHEN vendor = 2 THEN o_orderpriority END AS team,
  CAST(o_orderdate AS DATE) AS posted,
  CASE WHEN paid THEN 150000::BIGINT END AS salary_min, CASE WHEN paid THEN 200000::BIGINT END AS salary_max,
  CASE WHEN paid THEN CASE WHEN vendor = 5 THEN 'EUR' ELSE 'USD' END END AS salary_currency, seniority,
  CASE WHEN vendor <> 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Pay $150,000 - $200,000' ELSE 'Fair & square' END END AS description
FROM (SELECT *, o_custkey % 7 AS vendor, o_orderkey % 3 = 0 AND (o_custkey % 7 <> 5 OR o_orderkey % 2 = 0) AS paid, 'b' || o_custkey AS company, 'City' || (o_orderkey % 25) AS city,
    (['greenhouse', 'ashby', 'lever', 'workable', 'breezy', 'recruitee', 'teamtailor'])[o_custkey % 7 + 1] AS source FROM orders)
JOIN role_facts ON role = o_orderkey % 54""",
    )
)
def vendor_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_postings(by_source(_bodies(spark, sf_dir)))
    return rows.select(
        "source", "company", "job_id", "title", "url", "location", "workplace", "department", "team",
        F.col("posted_at").cast("date").alias("posted"), "salary_min", "salary_max", "salary_currency",
        "seniority", "description",
    )
