"""Public counters: JSON documents read on the executors, and the figures in them as rows."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.sources.boards import DEADLINE, fetch


def read_documents(
    requests: DataFrame,
    workers: int = 4,
    timeout: float = 30.0,
    unit: float = 1.0,
    until: float | None = None,
) -> DataFrame:
    """name, url, http, body and reason of each request (name, url); requests without an address are left out.

    Refusals and failures are tried again; ``until`` is a deadline as in
    ``boards.read_boards``.  Nothing that fails is lost: it has its reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, url in frame[["name", "url"]].itertuples(index=False):
                late = until is not None and time.time() >= until
                rows.append((name, url, *((None, None, DEADLINE) if late else fetch(url, timeout, unit))))
            out = pd.DataFrame(rows, columns=["name", "url", "http", "body", "reason"])
            out["http"] = out["http"].astype("Int32")
            yield out

    known = requests.select("name", "url").where(F.coalesce("url", F.lit("")) != "")
    schema = "name string, url string, http int, body string, reason string"
    return known.repartition(workers).mapInPandas(run, schema)


def counters(replies: DataFrame, paths: dict[str, str], read_at: Column) -> DataFrame:
    """read_at, name, counter and value of every figure of every document that was read.

    ``paths`` names each counter's place in a document; a figure that a
    document lacks is 0, a document that was not read has no rows.
    """
    figures = [
        F.struct(
            F.lit(counter).alias("counter"),
            F.coalesce(F.get_json_object("body", path).try_cast("double"), F.lit(0.0)).alias("value"),
        )
        for counter, path in paths.items()
    ]
    read = replies.where((F.col("http") == 200) & F.get_json_object("body", "$").isNotNull())
    each = read.select(read_at.alias("read_at"), "name", F.explode(F.array(*figures)).alias("f"))
    return each.select("read_at", "name", "f.counter", "f.value")
