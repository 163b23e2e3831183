"""Queries on title families: census, priors, leave-one-out, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions.text import classify_token, without_suffixes
from postpulse.operators import census
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query

ROLE = "family NOT IN ('suspect_recruitment_ad', 'volunteer_unpaid', 'generic', 'other', 'non_english')"
SPLIT = """board_split AS (
  SELECT board, CASE WHEN place < 8 THEN 'head' ELSE 'tail' END AS stratum,
    CASE WHEN place < 8 THEN 1.0::DOUBLE ELSE n_rest / n_taken::DOUBLE END AS weight
  FROM (SELECT *, count(*) FILTER (WHERE place >= 8) OVER () AS n_rest,
      count(*) FILTER (WHERE place >= 8 AND (place - 8) % 4 = 0) OVER () AS n_taken
    FROM (SELECT board, row_number() OVER (ORDER BY count(*) DESC, board) - 1 AS place
      FROM families GROUP BY 1))
  WHERE place < 8 OR (place - 8) % 4 = 0)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = b.families(spark, sf_dir).groupBy("board").agg(F.count("*").alias("postings"))
    return census.head_and_tail(boards, 8, 4)


@query(b.with_ctes(("families",), "SELECT * FROM board_split", (SPLIT,)))
def head_tail_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("board", "stratum", "weight")


@query(
    b.with_ctes(
        ("families",),
        """
SELECT *, head + tail_weighted AS estimate,
  (head + tail_weighted) / sum(head + tail_weighted) OVER () AS share
FROM (SELECT family, count(*) FILTER (WHERE stratum = 'head') AS head,
    coalesce(sum(weight) FILTER (WHERE stratum = 'tail'), 0)::DOUBLE AS tail_weighted
  FROM families JOIN board_split USING (board) GROUP BY 1)""",
        (SPLIT,),
    )
)
def census_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = _split(spark, sf_dir).select(F.col("board").alias("_b"), "stratum", "weight")
    titles = b.families(spark, sf_dir)
    return census.weighted_census(titles.join(sample, F.col("board") == F.col("_b")))


@query(
    b.with_ctes(
        ("families",),
        """
SELECT board, count(*) AS titles_read, count(*) FILTER (WHERE family = 'engineering') AS in_family,
  count(*) FILTER (WHERE family = 'engineering') / count(*) AS share FROM families GROUP BY 1""",
    )
)
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.category_share(b.families(spark, sf_dir), "engineering")


PRIOR = f"""prior AS (
  SELECT board, sum(n)::BIGINT AS titles_read,
    arg_min(family, (-n, family)) FILTER (WHERE {ROLE}) AS inferred_family,
    coalesce(sum(n) FILTER (WHERE {ROLE}), 0)::BIGINT AS support,
    max(n) FILTER (WHERE {ROLE}) / sum(n) FILTER (WHERE {ROLE}) AS confidence,
    coalesce(sum(n) FILTER (WHERE family IN ('suspect_recruitment_ad', 'volunteer_unpaid')), 0) / sum(n) AS junk_share
  FROM (SELECT board, family, count(*) AS n FROM families GROUP BY 1, 2) GROUP BY 1)"""


@query(b.with_ctes(("families",), "SELECT * FROM prior", (PRIOR,)))
def board_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.board_prior(b.families(spark, sf_dir))


@query(
    b.with_ctes(
        ("families",),
        """
SELECT f.board, f.family, p.board IS NOT NULL AND f.family = 'generic' AS taken,
  CASE WHEN f.family = 'generic' THEN coalesce(p.inferred_family, f.family) ELSE f.family END AS resolved,
  count(*) AS titles
FROM families f LEFT JOIN (FROM prior WHERE support >= 5 AND confidence >= 0.7 AND junk_share < 0.10) p
USING (board) GROUP BY ALL""",
        (PRIOR,),
    )
)
def prior_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = b.families(spark, sf_dir)
    found = census.applied_prior(titles, census.board_prior(titles))
    taken = F.col("assigned").isNotNull().alias("taken")
    return found.groupBy("board", "family", taken, "resolved").agg(F.count("*").alias("titles"))


_GRID = (
    "grid AS (SELECT unnest([1, 2, 3, 5, 8, 10]) AS least_support, c.least_confidence FROM "
    "(SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS least_confidence) c)"
)
LOO = f"""loo AS (
  SELECT least_support, least_confidence, titles, predicted, correct, predicted_weak, correct_weak,
    predicted / titles AS coverage, correct / nullif(predicted, 0) AS accuracy,
    correct_weak / nullif(predicted_weak, 0) AS weak_accuracy
  FROM (SELECT least_support, least_confidence, sum(n)::BIGINT AS titles,
      coalesce(sum(n) FILTER (WHERE fires), 0)::BIGINT AS predicted,
      coalesce(sum(n) FILTER (WHERE fires AND guess = family), 0)::BIGINT AS correct,
      coalesce(sum(n_weak) FILTER (WHERE fires), 0)::BIGINT AS predicted_weak,
      coalesce(sum(n_weak) FILTER (WHERE fires AND guess = family), 0)::BIGINT AS correct_weak
    FROM (SELECT r.*, g.*, r.support >= g.least_support AND r.confidence >= g.least_confidence AS fires
      FROM (SELECT board, family, n, n_weak, sum(others)::BIGINT AS support,
          arg_min(other, (-others, other)) FILTER (WHERE others > 0) AS guess,
          max(others) / nullif(sum(others), 0) AS confidence
        FROM (SELECT a.board, a.family, a.n, a.n_weak, o.family AS other,
            o.n - (o.family = a.family)::INT AS others FROM counts a JOIN counts o USING (board))
        GROUP BY 1, 2, 3, 4) r, grid g) GROUP BY 1, 2))"""
COUNTS = f"""counts AS (SELECT board, family, count(*) AS n, count(*) FILTER (WHERE weak) AS n_weak
  FROM families WHERE {ROLE} GROUP BY 1, 2)"""


@query(b.with_ctes(("families",), "SELECT * FROM loo", (COUNTS, _GRID, LOO)))
def prior_loo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.leave_one_out(b.families(spark, sf_dir))


@query(
    b.with_ctes(
        ("families",),
        """
SELECT * FROM loo WHERE weak_accuracy >= 0.90 AND least_support >= 5 AND predicted_weak >= 500
ORDER BY coverage DESC, least_support, least_confidence LIMIT 1""",
        (COUNTS, _GRID, LOO),
    )
)
def prior_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.chosen_point(census.leave_one_out(b.families(spark, sf_dir)))


BOARD_FAMILY = """board_family AS (SELECT board, CASE WHEN junk_share >= 0.10 THEN 'junk_board'
  WHEN inferred_family IS NULL THEN 'no_resolved_titles' ELSE inferred_family END AS title_family FROM prior)"""


@query(b.with_ctes(("families",), "SELECT * FROM board_family", (PRIOR, BOARD_FAMILY)))
def board_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.board_family(b.families(spark, sf_dir))


@query(
    b.with_ctes(
        ("families",),
        """
SELECT board, industry_family, title_family, CASE WHEN industry_family IS NULL OR title_family IS NULL
    OR title_family IN ('junk_board', 'no_resolved_titles') THEN 'unchecked'
  WHEN industry_family = title_family THEN 'agrees' ELSE 'disagrees' END AS checked
FROM (SELECT 't' || n AS board, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 2 = 0 THEN 'data' ELSE 'engineering' END
    AS industry_family FROM range(0, 45) r(n)) LEFT JOIN board_family USING (board)""",
        (PRIOR, BOARD_FAMILY),
    )
)
def industry_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    family = F.when(n % 3 == 0, None).when(n % 2 == 0, "data").otherwise("engineering")
    tokens = spark.range(45).select(
        F.concat(F.lit("t"), n).alias("board"), family.alias("industry_family")
    )
    return census.industry_fill(tokens, census.board_family(b.families(spark, sf_dir)))


@query(
    b.with_ctes(
        (),
        """
SELECT *, agreed / nullif(audited, 0) AS agreement,
  CASE WHEN audited = 0 THEN 0 ELSE greatest(0, (p + z2 / (2 * audited) - 1.96 * sqrt(p * (1 - p) / audited + z2 / (4.0 * audited * audited))) / (1 + z2 / audited)) END::DOUBLE AS low,
  CASE WHEN audited = 0 THEN 1 ELSE least(1, (p + z2 / (2 * audited) + 1.96 * sqrt(p * (1 - p) / audited + z2 / (4.0 * audited * audited))) / (1 + z2 / audited)) END::DOUBLE AS high,
  CASE WHEN audited = fired THEN 'census' ELSE 'sample' END AS basis,
  CASE WHEN audited >= 5 AND agreed / nullif(audited, 0) >= 0.7 THEN 'keep' ELSE 'drop' END AS verdict
FROM (SELECT p_brand AS key, count(*) AS raw_hits, count(*) FILTER (WHERE p_size % 5 = 0) AS blocked_hits,
    count(*) FILTER (WHERE p_size % 5 <> 0) AS fired,
    count(*) FILTER (WHERE p_size % 5 <> 0 AND p_partkey % 9 = 0) AS audited,
    count(*) FILTER (WHERE p_size % 5 <> 0 AND p_partkey % 9 = 0 AND p_type <> 'PROMO') AS agreed
  FROM part GROUP BY 1),
LATERAL (SELECT agreed / nullif(audited, 0) AS p, (1.96 * 1.96)::DOUBLE AS z2)""".replace(
            "SELECT *, agreed", "SELECT key, raw_hits, blocked_hits, fired, audited, agreed, agreed"
        ),
    )
)
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "part")
    blocked = F.col("p_size") % 5 == 0
    hits = parts.select(
        F.col("p_brand").alias("key"),
        blocked.alias("blocked"),
        (~blocked).alias("fired"),
        F.when(F.col("p_partkey") % 9 == 0, F.col("p_type") != "PROMO").alias("agrees"),
    )
    return census.key_audit(hits)


# What a token may end in after its number and an x: the words that stay and the
# endings that go; then the industry, the key that fires and its mode.
TOKENS = [
    ("bondvet", "", "healthcare", "vet", "end"),
    ("lansingpetvet", "inc", "healthcare", "vet", "end"),
    ("svetness", "", None, None, None),
    ("fivetran", "-jobs", None, None, None),
    ("dental", "careus", "healthcare", "dental", "sub"),
    ("freedomcare", "", "healthcare", "care", "sub"),
    ("", "careers", None, None, None),
    ("daycarecenter", "", "education", "daycare", "sub"),
    ("hospital", "groupllc", "healthcare", "hospital", "sub"),
    ("robotics", "co", "engineering", "robotics", "sub"),
    ("software", "1234", "engineering", "software", "sub"),
    ("acme", "inc99", None, None, None),
    ("petvet", "123jobs", "healthcare", "vet", "end"),
    ("software", "careers", "engineering", "software", "sub"),
    ("lawnmower", "ukglobalholdings", None, None, None),
    ("smithlaw", "", "corporate", "law", "sub"),
    ("burbank", "-usa", None, None, None),
    ("first-bank", "_ltd", "corporate", "bank", "sub"),
]
_KEPT = {"first-bank": "firstbank", "": "", "dental": "dentalcare"}
_TOKEN_FACTS = b.values_cte(
    "facts",
    ("place", "word", "ending", "kept", "family", "key", "mode"),
    [(k, t[0], t[1], _KEPT.get(t[0], t[0]), *t[2:]) for k, t in enumerate(TOKENS)],
)
_TOKEN = "'b' || c_custkey || 'x' || word || ending"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("c_custkey") % len(TOKENS)
    word, ending = (b.pick(place, [t[k] for t in TOKENS]) for k in (0, 1))
    token = F.concat(F.lit("b"), "c_custkey", F.lit("x"), word, ending)
    return b.table(spark, sf_dir, "customer").select(token.alias("token"))


@query(
    b.with_ctes(
        (),
        f"""
SELECT {_TOKEN} AS token, 'b' || c_custkey || 'x' || kept AS stripped
FROM customer JOIN facts ON place = c_custkey % {len(TOKENS)}""",
        (_TOKEN_FACTS,),
    )
)
def token_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("token", without_suffixes("token").alias("stripped"))


@query(
    b.with_ctes(
        (),
        f"""
SELECT {_TOKEN} AS token, family, key, mode
FROM customer JOIN facts ON place = c_custkey % {len(TOKENS)}""",
        (_TOKEN_FACTS,),
    )
)
def token_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tokens(spark, sf_dir).withColumn("c", classify_token("token"))
    return rows.select("token", "c.*")


@query(
    """
SELECT family, key, count(*) AS hits, list_sort(list(title ORDER BY title)[:3]) AS examples FROM (
  SELECT p_name AS title, CASE WHEN p_name LIKE '%ring%' THEN 'jewel' WHEN p_name LIKE '%gear%' THEN 'machine'
      WHEN p_name LIKE '%bolt%' THEN 'machine' END AS family,
    CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%gear%' THEN 'gear'
      WHEN p_name LIKE '%bolt%' THEN 'bolt' END AS key FROM part)
WHERE key IS NOT NULL GROUP BY 1, 2"""
)
def lexicon_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postpulse.functions.text import title_key

    families = (("jewel", ("ring",)), ("machine", ("gear", "bolt")))
    parts = b.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))
    keyed = parts.withColumn("k", title_key("title", families)).select("title", "k.*")
    return census.lexicon_audit(keyed.where("key is not null"))
