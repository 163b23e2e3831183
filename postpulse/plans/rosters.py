"""Queries on probes, rosters, strata and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators import roster, sampling
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query

VERDICTS = """verdicts AS (
  SELECT provider, token, run, jobs, CASE WHEN http IS NULL THEN 'error' WHEN http IN (404, 410) THEN 'dead'
    WHEN http IN (403, 429) OR http >= 500 THEN 'blocked' WHEN http < 200 OR http >= 300 THEN 'dead'
    WHEN NOT shape_ok THEN 'dead' WHEN jobs > 0 THEN 'live' ELSE 'empty' END AS status FROM probes)"""
LAYERED = """layered AS (
  SELECT provider, token, run, jobs, status FROM (SELECT *, row_number() OVER (
    PARTITION BY provider, token ORDER BY run DESC, jobs DESC, status DESC) AS n FROM verdicts) WHERE n = 1)"""
_CTES = (VERDICTS, LAYERED)


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.probes(spark, sf_dir)
    status = roster.probe_status(F.col("http"), F.col("shape_ok"), F.col("jobs"))
    runs = rows.select("provider", "token", "run", "jobs", status.alias("status"))
    return roster.layered(runs, ("provider", "token"), "run")


@query(
    b.with_ctes(
        ("probes",),
        "SELECT status, count(*) AS replies FROM verdicts GROUP BY 1",
        (VERDICTS,),
    )
)
def probe_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = roster.probe_status(F.col("http"), F.col("shape_ok"), F.col("jobs"))
    rows = b.probes(spark, sf_dir).select(status.alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("replies"))


@query(b.with_ctes(("probes",), "SELECT * FROM layered", _CTES))
def roster_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layered(spark, sf_dir)


SUMMARY = """summary AS (
  SELECT provider, count(*) AS candidates, count(*) FILTER (WHERE status = 'live') AS live,
    count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'dead') AS dead,
    count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'blocked') AS blocked,
    coalesce(sum(jobs) FILTER (WHERE status = 'live'), 0)::BIGINT AS postings,
    count(*) FILTER (WHERE status <> 'blocked') AS resolved,
    CASE WHEN count(*) FILTER (WHERE status <> 'blocked') > 0 THEN
      floor(count(*) FILTER (WHERE status = 'live') / count(*) FILTER (WHERE status <> 'blocked') * 10000 + 0.5) / 10000
    END AS hit_rate,
    (list_sort(list(jobs) FILTER (WHERE status = 'live')))[
      (count(*) FILTER (WHERE status = 'live') // 2) + 1] AS median_live
  FROM layered GROUP BY 1)"""


@query(b.with_ctes(("probes",), "SELECT * FROM summary", (*_CTES, SUMMARY)))
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.coverage_summary(_layered(spark, sf_dir))


PROJECTED = """projected AS (
  SELECT s.provider, candidates, harvested,
    floor(live * (harvested / candidates) + 0.5)::BIGINT AS projected_live,
    floor(postings * (harvested / candidates) + 0.5)::BIGINT AS projected_postings
  FROM summary s JOIN (SELECT 'v' || (p_partkey % 6) AS provider, count(*) * 3 AS harvested
    FROM part GROUP BY 1) h USING (provider))"""


def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "part")
    harvested = parts.groupBy(F.concat(F.lit("v"), F.col("p_partkey") % 6).alias("provider"))
    harvested = harvested.agg((F.count("*") * 3).alias("harvested"))
    summary = roster.coverage_summary(_layered(spark, sf_dir))
    return roster.coverage_projection(summary, harvested)


@query(b.with_ctes(("probes",), "SELECT * FROM projected", (*_CTES, SUMMARY, PROJECTED)))
def coverage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir)


@query(
    b.with_ctes(
        ("probes",),
        """
SELECT sum(projected_live)::BIGINT AS companies, sum(projected_postings)::BIGINT AS postings,
  sum(projected_live) >= 10000 AND sum(projected_postings) >= 150000 AS passed FROM projected""",
        (*_CTES, SUMMARY, PROJECTED),
    )
)
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.gate(_projection(spark, sf_dir))


@query(
    b.with_ctes(
        ("probes",),
        """
SELECT CASE WHEN grouping(provider) = 1 THEN 'all' ELSE provider END AS provider, count(*) AS candidates,
  count(*) FILTER (WHERE status = 'live') AS live, count(*) FILTER (WHERE status = 'empty') AS empty,
  count(*) FILTER (WHERE status NOT IN ('live', 'empty')) AS dead,
  coalesce(sum(jobs) FILTER (WHERE status = 'live'), 0)::BIGINT AS postings,
  floor(count(*) FILTER (WHERE status = 'live') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS live_pct
FROM layered GROUP BY ROLLUP (provider)""",
        _CTES,
    )
)
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.coverage_rollup(_layered(spark, sf_dir))


def _ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = b.table(spark, sf_dir, "customer")
    token = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    rows = customers.where("c_acctbal > 1000")
    return rows.select(
        F.concat(F.lit("m"), F.col("c_nationkey") % 4).alias("provider"), token.alias("token")
    )


def _theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = b.table(spark, sf_dir, "customer")
    token = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    moved = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("jobs."), token)).otherwise(token)
    rows = customers.where("c_acctbal < 5000")
    return rows.select(
        F.concat(F.lit("m"), F.col("c_nationkey") % 4).alias("provider"),
        moved.alias("token"),
        F.col("c_name").alias("company"),
    )


OURS = """ours AS (SELECT 'm' || (c_nationkey % 4) AS provider, lower(replace(c_name, '#', '-')) AS token
  FROM customer WHERE c_acctbal > 1000)"""
THEIRS = """theirs AS (SELECT 'm' || (c_nationkey % 4) AS provider,
  CASE WHEN c_custkey % 5 = 0 THEN 'jobs.' ELSE '' END || lower(replace(c_name, '#', '-')) AS token,
  c_name AS company FROM customer WHERE c_acctbal < 5000)"""


@query(
    b.with_ctes(
        (),
        """
SELECT provider, token, CASE WHEN o AND t THEN 'shared' WHEN t THEN 'theirs_only'
  WHEN EXISTS (FROM theirs x WHERE x.provider = z.provider AND regexp_replace(lower(x.company), '[^a-z0-9]', '', 'g')
    = regexp_replace(lower(z.token), '[^a-z0-9]', '', 'g')) THEN 'ours_custom_domain' ELSE 'ours_only' END AS kind
FROM (SELECT provider, token, bool_or(side = 'o') AS o, bool_or(side = 't') AS t
  FROM (SELECT provider, token, 'o' AS side FROM ours UNION ALL SELECT provider, token, 't' FROM theirs)
  GROUP BY 1, 2) z""",
        (OURS, THEIRS),
    )
)
def roster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.roster_difference(_ours(spark, sf_dir), _theirs(spark, sf_dir))


@query(
    b.with_ctes(
        (),
        "SELECT provider, token FROM ours UNION SELECT provider, token FROM theirs",
        (OURS, THEIRS),
    )
)
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.merged_candidates(_ours(spark, sf_dir), _theirs(spark, sf_dir))


@query(
    b.with_ctes(
        (),
        "SELECT provider, token FROM ours WHERE (provider, token) NOT IN (SELECT provider, token FROM theirs)",
        (OURS, THEIRS),
    )
)
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.not_yet(_ours(spark, sf_dir), _theirs(spark, sf_dir), ("provider", "token"))


@query(
    b.with_ctes(
        ("probes",),
        """
SELECT provider AS source_provider, 'v' || (run % 6) AS target_provider, count(*) AS tried,
  count(*) FILTER (WHERE status = 'live') AS hits,
  floor(count(*) FILTER (WHERE status = 'live') / count(*) * 10000 + 0.5) / 10000 AS hit_rate
FROM verdicts GROUP BY 1, 2""",
        (VERDICTS,),
    )
)
def cross_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.probes(spark, sf_dir)
    status = roster.probe_status(F.col("http"), F.col("shape_ok"), F.col("jobs"))
    pairs = rows.select(
        F.col("provider").alias("source_provider"),
        F.concat(F.lit("v"), F.col("run") % 6).alias("target_provider"),
        status.alias("status"),
    )
    return roster.cross_hits(pairs)


PROVIDERS = ("p0", "p1", "p2")

#: The generator in 32-bit arithmetic, at the place that an item's digest names; seed 7.
_DRAWS = """
WITH tokens AS (SELECT 'p' || (c_custkey % 3) AS provider, lower(c_name) AS token, min(c_custkey) AS k
    FROM customer GROUP BY 1, 2),
a AS (SELECT *, (7 + (('0x' || substr(md5(provider || '|' || token), 1, 8))::HUGEINT + 1) * 1831565813) % 4294967296 AS s
  FROM tokens),
b AS (SELECT *, (xor(s, s >> 15) * (s | 1)) % 4294967296 AS m FROM a),
c AS (SELECT *, xor(m, (m + (xor(m, m >> 7) * (m | 61)) % 4294967296) % 4294967296) AS t FROM b),
drawn AS (SELECT provider, token, k, xor(t, t >> 14)::DOUBLE / 4294967296 AS draw FROM c),
sampled AS (SELECT * FROM drawn
  QUALIFY row_number() OVER (PARTITION BY provider ORDER BY draw, token) <= 100)"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = b.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey") % 3).alias("provider"), F.lower("c_name").alias("token")
    )
    return sampling.counter_samples(tokens, "provider", "token", 100, 7, least=20)


@query(f"{_DRAWS} SELECT provider, token, draw FROM sampled")
def token_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred tokens of each provider, drawn without an order."""
    return _sampled(spark, sf_dir)


@query(
    f"""{_DRAWS}
SELECT provider AS source_provider, target AS target_provider, count(*) AS tried,
  count(*) FILTER (WHERE orders > 0) AS hits,
  floor(count(*) FILTER (WHERE orders > 0) / count(*) * 10000 + 0.5) / 10000 AS hit_rate
FROM (SELECT s.*, target, (SELECT count(*) FROM orders WHERE o_custkey = k
    AND 'p' || (length(o_orderpriority) % 3) = target) AS orders
  FROM sampled s, (VALUES ('p0'), ('p1'), ('p2')) t(target) WHERE target <> provider)
GROUP BY 1, 2"""
)
def cross_probe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled tokens tried at the other providers: those whose customers have orders there are live."""
    pairs = roster.cross_pairs(_sampled(spark, sf_dir), PROVIDERS)
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("token"))
    there = F.concat(F.lit("p"), F.length("o_orderpriority") % 3).alias("target_provider")
    orders = b.table(spark, sf_dir, "orders").select("o_custkey", there).distinct()
    live = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("token", "target_provider")
    found = pairs.join(live.withColumn("live", F.lit(True)), ["token", "target_provider"], "left")
    return roster.cross_hits(found.withColumn("status", F.when(F.col("live"), "live").otherwise("dead")))


# Strata for boards of orders: far smaller and flatter than job boards.
STRATA = (("12+", 12, None), ("9-11", 9, 40), ("5-8", 5, 30), ("1-4", 1, 20))
PLAN = """plan AS (
  SELECT stratum, stratum = '12+' AS census, boards, postings,
    postings / sum(postings) OVER () AS weight,
    least(boards, CASE stratum WHEN '12+' THEN boards WHEN '9-11' THEN 40 WHEN '5-8' THEN 30 ELSE 20 END) AS target
  FROM (SELECT stratum, count(*) AS boards, sum(postings)::BIGINT AS postings FROM placed GROUP BY 1))"""
PLACED = """placed AS (SELECT *, CASE WHEN postings >= 12 THEN '12+' WHEN postings >= 9 THEN '9-11'
  WHEN postings >= 5 THEN '5-8' ELSE '1-4' END AS stratum FROM board_sizes)"""
SAMPLED = """sampled AS (
  SELECT board, postings, extra, stratum FROM (SELECT p.*, l.boards AS n, l.target,
      row_number() OVER (PARTITION BY stratum ORDER BY p.postings DESC, board) - 1 AS place
    FROM placed p JOIN plan l USING (stratum)) x
  WHERE place IN (SELECT CAST(floor(i * x.n / x.target) AS BIGINT) FROM range(0, x.target) r(i)))"""
RATES = """rates AS (SELECT stratum, count(*) AS boards_read, sum(postings)::BIGINT AS postings_read,
  sum(extra)::BIGINT AS extra, count(*) FILTER (WHERE extra > 0) AS boards_with_any,
  sum(extra) / sum(postings) AS rate FROM sampled GROUP BY 1)"""
_STRATA = (PLACED, PLAN, SAMPLED, RATES)


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boards = b.board_sizes(spark, sf_dir)
    return boards, sampling.strata_plan(boards, STRATA)


@query(b.with_ctes(("board_sizes",), "SELECT * FROM plan", (PLACED, PLAN)))
def strata_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


@query(b.with_ctes(("board_sizes",), "SELECT * FROM sampled", (PLACED, PLAN, SAMPLED)))
def every_kth_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every_kth(*_plan(spark, sf_dir), STRATA)


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boards, plan = _plan(spark, sf_dir)
    return sampling.stratum_rates(sampling.every_kth(boards, plan, STRATA)), plan


@query(b.with_ctes(("board_sizes",), "SELECT * FROM rates", _STRATA))
def stratum_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)[0]


@query(
    b.with_ctes(
        ("board_sizes",),
        "SELECT sum(weight * rate) / sum(weight) AS rate, count(*) AS strata FROM rates JOIN plan USING (stratum)",
        _STRATA,
    )
)
def combined_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.combined_rate(*_rates(spark, sf_dir))


@query(
    b.with_ctes(
        ("board_sizes",),
        """
SELECT sum(extra)::BIGINT AS total, count(*) FILTER (WHERE extra > 0) AS boards,
  sum(extra) FILTER (WHERE place = 1) / sum(extra) AS top_1,
  sum(extra) FILTER (WHERE place <= 10) / sum(extra) AS top_10,
  sum(extra) FILTER (WHERE place <= 25) / sum(extra) AS top_25
FROM (SELECT *, row_number() OVER (ORDER BY extra DESC, board) AS place FROM board_sizes)""",
    )
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.concentration(b.board_sizes(spark, sf_dir))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Censuses count as sums; only the sampled boards, ninety at most, are collected."""
    boards, plan = _plan(spark, sf_dir)
    strata = sampling.drawn_boards(sampling.every_kth(boards, plan, STRATA), plan)
    order = [n for n, _, _ in STRATA]
    strata.sort(key=lambda s: order.index(s["name"]))
    return sampling.interval(sampling.bootstrap_draws(spark, strata))


_BOARDS = """boards AS (SELECT provider, token, status, jobs AS open_postings FROM layered)"""


@query(
    b.with_ctes(
        ("probes",),
        """
SELECT provider, token, status, open_postings, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY CASE status WHEN 'live' THEN 1 ELSE 2 END,
    open_postings DESC, token) AS place FROM boards
  WHERE status IN ('live', 'empty') AND provider IN ('v0', 'v2', 'v3')) WHERE place <= 40""",
        (*_CTES, _BOARDS),
    )
)
def boards_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layered(spark, sf_dir).withColumnRenamed("jobs", "open_postings")
    found = roster.boards_to_read(rows, 40, ("v0", "v2", "v3"), with_empty=True)
    return found.select("provider", "token", "status", "open_postings", "place")


@query(
    b.with_ctes(
        ("probes",),
        """
SELECT provider, token, run, jobs, status FROM (SELECT *, row_number() OVER (PARTITION BY provider, token
  ORDER BY run DESC) AS n FROM (SELECT * FROM layered UNION ALL
    SELECT provider, token, run + 10000000000, 7, 'live' FROM layered WHERE status IN ('error', 'blocked')
      AND length(token) % 2 = 0)) WHERE n = 1""",
        _CTES,
    )
)
def reprobe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _layered(spark, sf_dir)
    odd = F.length("token") % 2 == 1
    again = latest.withColumns(
        {
            "run": F.col("run") + 10_000_000_000,
            "jobs": F.when(odd, 0).otherwise(7).cast("long"),
            "status": F.when(odd, "blocked").otherwise("live"),
        }
    )
    found = roster.reprobed(latest, again, ("error", "blocked"))
    return found.select("provider", "token", "run", "jobs", "status")


@query(
    b.with_ctes(
        ("probes",), "SELECT count(*) AS hits FROM boards WHERE contains(token, 'k1')", (*_CTES, _BOARDS)
    )
)
def board_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roster.board_search(_layered(spark, sf_dir), " K1 ")
    return found.agg(F.count("*").alias("hits"))
