"""Queries on repeated readings and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.operators import filters, market, readings
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ts").cast("timestamp_ntz").cast("date")
    return b.table(spark, sf_dir, "events").withColumn("read_at", day)


@query(
    """
SELECT name, read_at, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS change
FROM (SELECT event_type AS name, CAST(ts AS DATE) AS read_at, count(*) AS value FROM events GROUP BY 1, 2)
WINDOW w AS (PARTITION BY name ORDER BY read_at)"""
)
def counter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _daily(spark, sf_dir).groupBy(F.col("event_type").alias("name"), "read_at")
    return readings.counter_changes(counts.agg(F.count("*").alias("value")))


@query(
    """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS read_at FROM events),
names AS (SELECT DISTINCT user_id AS name FROM events),
seen AS (SELECT DISTINCT user_id AS name, CAST(ts AS DATE) AS read_at FROM events),
read AS (SELECT n.name, d.read_at, s.name IS NOT NULL AS present FROM names n, days d
  LEFT JOIN seen s ON s.name = n.name AND s.read_at = d.read_at),
ok AS (SELECT read_at, bool_and(present) AS ok FROM read WHERE name IN (1, 2) GROUP BY 1)
SELECT name, read_at, present, was_present FROM (
  SELECT r.name, r.read_at, r.present, lag(r.present) OVER (PARTITION BY r.name ORDER BY r.read_at) AS was_present
  FROM read r JOIN ok USING (read_at) WHERE r.present OR ok.ok) WHERE present <> was_present"""
)
def presence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _daily(spark, sf_dir).select(F.col("user_id").alias("name"), "read_at").distinct()
    # One row for each name with all days: days are few, names are spread.
    days = seen.agg(F.collect_set("read_at").alias("days"))
    own = seen.groupBy("name").agg(F.collect_set("read_at").alias("own"))
    every = own.join(days, F.lit(True)).select("name", "own", F.explode("days").alias("read_at"))
    present = every.select("name", "read_at", F.array_contains("own", F.col("read_at")).alias("present"))
    controls = present.where(F.col("name").isin(1, 2)).select(
        "read_at", F.col("present").alias("found")
    )
    found = readings.presence_changes(present, controls)
    return found.select("name", "read_at", "present", "was_present")


@query(
    """
SELECT user_id, arg_max(value, event_id) AS price, count(*) AS records FROM events GROUP BY 1"""
)
def current_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    history = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    rows = events.groupBy("user_id").agg(history.alias("history"))
    last = readings.current_record(F.col("history"))
    return rows.select("user_id", last["value"].alias("price"), F.size("history").cast("long").alias("records"))


@query(
    """
SELECT count(*) AS postings,
  floor(count(*) FILTER (WHERE o_totalprice > 200000) / count(*) * 1000 + 0.5) / 1000 AS with_salary,
  floor(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 1000 + 0.5) / 1000 AS remote FROM orders"""
)
def enrichment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders")
    rows = orders.select(
        F.when(F.col("o_totalprice") > 200_000, F.col("o_totalprice")).alias("salary_min"),
        F.when(F.col("o_orderstatus") == "F", "remote").alias("workplace"),
    )
    return market.enrichment_shares(rows)


@query(
    """
SELECT s_suppkey, array_to_string(list_filter([
  CASE WHEN NOT (contains(lower(s_name), '00001') AND contains(lower(s_name), 'supplier')) THEN 's_name' END],
  lambda x: x IS NOT NULL), ',') AS stale FROM supplier"""
)
def listing_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = b.table(spark, sf_dir, "supplier")
    found = filters.listing_stale_fields(suppliers, ["s_name"], "00001", ["supplier"])
    return found.select("s_suppkey", F.array_join("stale_fields", ",").alias("stale"))


@query(
    """
SELECT key, board, pos, postings, cached,
  CAST(row_number() OVER (PARTITION BY key ORDER BY postings DESC, board) AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY key, cached ORDER BY pos) AS place FROM (
    SELECT p_type AS key, 'k' || p_partkey AS board, p_partkey AS pos, p_size AS postings,
      p_partkey % 7 = 0 AS cached FROM part))
WHERE cached OR place <= 12"""
)
def audit_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "part")
    hits = parts.select(
        F.col("p_type").alias("key"),
        F.concat(F.lit("k"), "p_partkey").alias("board"),
        F.col("p_partkey").alias("pos"),
        F.col("p_size").alias("postings"),
    )
    cached = hits.where(F.col("pos") % 7 == 0).select("board")
    return readings.audit_queue(hits, cached)
