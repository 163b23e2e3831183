"""Sinks: feeds, fixed-header CSV, immutable issues, manifests, resumable series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed(rows: DataFrame, path: str, most: int | None = None) -> None:
    """JSON lines, at most ``most`` rows if a cap is set."""
    (rows if most is None else rows.limit(most)).write.mode("overwrite").json(path)


def csv_artifact(rows: DataFrame, path: str, header: list[str]) -> None:
    """CSV with exactly these columns in this order, properly quoted."""
    rows.select(*header).write.mode("overwrite").option("header", True).csv(path)


def issue(rows: DataFrame, path: str, day: str, force: bool = False) -> None:
    """One immutable issue below ``issue_date=``; an existing one needs ``force``."""
    mode = "overwrite" if force else "errorifexists"
    rows.write.mode(mode).json(f"{path}/issue_date={day}")


def manifest(rows: DataFrame, day: str, source: str, planned: int) -> DataFrame:
    """One row about a snapshot: rows, providers, and whether it is complete."""
    return rows.agg(
        F.lit(day).alias("date"),
        F.count("*").alias("rows"),
        F.array_sort(F.collect_set("p")).alias("providers"),
        (F.count("*") >= planned).alias("complete"),
        F.lit(source).alias("source"),
    )


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the series does not hold yet, so reruns are harmless."""
    spark = rows.sparkSession
    done = existing(spark, path, rows)
    rows.join(done.select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The series at ``path``, or an empty one with ``like``'s schema."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def widened(old: DataFrame, reading: DataFrame) -> DataFrame:
    """Old readings and a new one under the union of their columns."""
    return old.unionByName(reading, allowMissingColumns=True)


def budget_shares(available: dict[str, int], most: int) -> dict[str, int]:
    """Rows each provider may deliver: what is left over equal shares of those to come."""
    shares, pushed, names = {}, 0, list(available)
    for k, name in enumerate(names):
        share = -(-(most - pushed) // (len(names) - k))
        shares[name] = min(available[name], share)
        pushed += shares[name]
    return shares


def save_tokens(tokens: DataFrame, path: str) -> None:
    """Add a harvest's (provider, token) pairs to the checkpoint; what it holds stays."""
    append_new(tokens.select("provider", "token").distinct(), path, ["provider", "token"])


def saved_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All pairs of the checkpoint, each once, in order; none before the first harvest."""
    like = spark.createDataFrame([], "provider string, token string")
    return existing(spark, path, like).distinct().orderBy("provider", "token")
