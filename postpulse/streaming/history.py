"""The daily history as a file stream: resumable, idempotent, late readings win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from postpulse.sources.files import HISTORY

KEYS = ["snapshot_date", "p", "t"]


def history_stream(spark: SparkSession, path: str) -> DataFrame:
    """Readings below ``snapshot_date=`` folders; lines that do not parse are dropped.

    A board that could not be read has no line: it is absent, never zero.
    """
    lines = (
        spark.readStream.schema(f"{HISTORY}, snapshot_date date")
        .option("mode", "DROPMALFORMED")
        .json(path)
    )
    return lines.where(F.col("p").isNotNull() & F.col("t").isNotNull())


def daily_totals(stream: DataFrame, late_by: str = "2 days") -> DataFrame:
    """Boards and postings by day and provider; repeated readings count once."""
    timed = stream.withColumn("day", F.col("snapshot_date").cast("timestamp"))
    once = timed.withWatermark("day", late_by).dropDuplicates(["day", "p", "t"])
    return once.groupBy(F.window("day", "1 day").alias("w"), "p").agg(
        F.count("*").alias("boards"), F.sum("j").alias("postings")
    ).select(F.col("w.start").cast("date").alias("snapshot_date"), "p", "boards", "postings")


def append_series(stream: DataFrame, table_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends only keys the series lacks; replays change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        from postpulse.sources.sinks import append_new

        append_new(batch.dropDuplicates(KEYS), table_path, KEYS)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def latest_readings(readings: DataFrame, ordinal: str) -> DataFrame:
    """Of each key the reading with the highest ordinal: the last write wins."""
    from postpulse.operators.roster import layered

    return layered(readings, tuple(KEYS), ordinal)


def board_signals(stream_batch: DataFrame, as_of: str) -> DataFrame:
    """Signals of the boards of one batch; whole boards arrive together."""
    from postpulse.operators.signals import company_signal

    return company_signal(stream_batch, as_of)


def signal_stream(
    stream: DataFrame, as_of: str, table_path: str, checkpoint: str
) -> DataStreamWriter:
    """A writer of the signals of each micro-batch's boards, as soon as they are read.

    A file of the stream holds whole boards, so no state crosses batches; for
    boards that come in pieces there is ``streaming.live``.  Every batch has a
    folder of its number, so a batch that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        board_signals(batch, as_of).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
