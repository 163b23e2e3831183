"""File sources: tolerant JSON lines, positional CSV, sitemaps, issues by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROSTER = "provider string, token string, open_postings bigint, board_url string, api_url string"
HISTORY = "p string, t string, j int, gone int"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines without those that do not parse, such as a torn last one."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_counted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``_corrupt_record`` set where a line did not parse."""
    full = f"{schema}, _corrupt_record string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def roster_csv(spark: SparkSession, path: str, positive_only: bool = False) -> DataFrame:
    """Boards of a roster; rows without provider, token or a finite count are dropped."""
    rows = spark.read.schema(ROSTER).option("header", True).option("mode", "PERMISSIVE").csv(path)
    keep = F.coalesce(F.col("provider"), F.lit("")) != ""
    keep &= F.coalesce(F.col("token"), F.lit("")) != ""
    keep &= F.col("open_postings").isNotNull()
    if positive_only:
        keep &= F.col("open_postings") > 0
    return rows.where(keep)


def parquet_tokens(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Tokens of a remote URL table and their rows; only the url column is read."""
    urls = spark.read.parquet(path).select("url")
    token = F.lower(F.regexp_extract("url", pattern, 1))
    counts = urls.select(token.alias("token")).where("token <> ''").groupBy("token")
    return counts.agg(F.count("*").alias("rows"))


def sitemap_locations(spark: SparkSession, path: str) -> DataFrame:
    """The locations of sitemap files, one row each."""
    files = spark.read.option("wholetext", True).text(path)
    found = F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return files.select(F.explode(found).alias("location"))


def issues(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All issues below ``path``; ``issue_date`` comes from the folders and prunes."""
    return spark.read.schema(schema).option("basePath", path).json(path)


def history_days(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Readings of the days from ``since`` to ``until``, both included; other days' folders are not listed as input."""
    rows = spark.read.schema(f"{HISTORY}, snapshot_date date").option("mode", "DROPMALFORMED").json(path)
    day = F.col("snapshot_date")
    if since is not None:
        rows = rows.where(day >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(day <= F.lit(until).cast("date"))
    return rows.where(F.col("p").isNotNull() & F.col("t").isNotNull())


def latest_before(issues_: DataFrame, day: str) -> DataFrame:
    """One row: the latest issue date before ``day``, null if there is none."""
    return issues_.where(F.col("issue_date") < F.lit(day).cast("date")).agg(
        F.max("issue_date").alias("previous")
    )
