"""Crawl queries: the pages table as a crawl's index, read through the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.functions import text
from postpulse.operators.staging import fresh_folder
from postpulse.plans import bindings as b
from postpulse.plans.catalogue import query
from postpulse.sources import crawl_index

_RECORDS = """
SELECT array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.')), ',') || ')'
    || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1), ''), '/') AS key,
  lpad((20250101000000 + page_id)::VARCHAR, 14, '0') AS timestamp, url, '200' AS status,
  page_id::VARCHAR AS "offset", length(html)::VARCHAR AS "length"
FROM pages"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into a crawl index in the shared folder, and the index as a table."""
    crawl_index.register(spark)
    pages = b.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^#]*)", 1)
    surt = F.regexp_replace(text.surt_prefix(host), "/$", "")
    rows = pages.select(
        F.lit(None).cast("string").alias("crawl"),
        F.concat(surt, F.when(path == "", "/").otherwise(path)).alias("key"),
        (F.lit(20250101000000) + F.col("page_id")).cast("string").alias("timestamp"),
        "url",
        F.lit("200").alias("status"),
        F.lit("text/html").alias("mime"),
        F.lit("pages").alias("filename"),
        F.col("page_id").cast("string").alias("offset"),
        F.length("html").cast("string").alias("length"),
        F.lit(None).cast("string").alias("error"),
    )
    path = fresh_folder(spark, "crawl-index")
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key")
    dealt.write.format("crawl_index").option("path", path).option("block_lines", 200).mode("append").save()
    found = crawl_index.table(spark, path, task_bytes=1 << 14)
    return found.select("key", "timestamp", "url", "status", "offset", "length")


@query(_RECORDS)
def crawl_index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index, written and read back."""
    return _index(spark, sf_dir)


@query(f"SELECT * FROM ({_RECORDS}) WHERE starts_with(key, 'com,example,')")
def crawl_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain's captures: the pushed prefix reaches the index, and other blocks are not read."""
    return _index(spark, sf_dir).where(F.col("key").startswith("com,example,"))
