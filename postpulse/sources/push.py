"""A push with a cap over all tasks, ``df.write.format("capped_push")``.

Tasks write their rows as batches (JSON lines, one file each), none more than
the whole cap.  The commit then claims batches in order until the cap, or the
budget if that is less, is used up: the batch that crosses it is cut, the rest
is given back (its files go).  What was delivered is what the manifest names;
a job that fails leaves no batch and no manifest.

Options: ``path`` (a folder of any file system that Arrow opens), ``cap``,
``budget`` (rows that the receiver still pays for; none: no bound),
``batch_rows``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from postpulse.sources import stores

MANIFEST = "delivery.json"


@dataclass
class Pushed(ds.WriterCommitMessage):
    """Batches of one task: names and numbers of rows, and how many rows it had at least."""

    batches: list[tuple[str, int]]
    offered: int


class CappedWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        bounds = [int(options[k]) for k in ("cap", "budget") if k in options]
        self.most = max(0, min(bounds)) if bounds else None
        self.cap = int(options["cap"]) if "cap" in options else None
        self.batch_rows = int(options.get("batch_rows", 500))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Pushed:
        done: list[tuple[str, int]] = []
        held: list[str] = []
        offered = taken = 0

        def flush() -> None:
            name = f"batch-{uuid.uuid4().hex}.jsonl"
            stores.write(stores.below(self.folder, name), "".join(held).encode())
            done.append((name, len(held)))
            held.clear()

        for batch in batches:
            offered += batch.num_rows
            room = batch.num_rows if self.most is None else self.most - taken
            for row in batch.slice(0, max(0, room)).to_pylist():
                held.append(json.dumps(row, default=str, ensure_ascii=False) + "\n")
                taken += 1
                if len(held) == self.batch_rows:
                    flush()
        if held:
            flush()
        return Pushed(done, offered)

    def commit(self, messages: list[Pushed | None]) -> None:
        delivered: list[str] = []
        pushed = 0
        offered = sum(m.offered for m in messages if m)
        for name, rows in (b for m in messages if m for b in m.batches):
            room = rows if self.most is None else min(rows, self.most - pushed)
            address = stores.below(self.folder, name)
            if room < rows:
                kept = stores.whole(address).split(b"\n")[:room] if room else []
                stores.remove(address)
                name = f"batch-{uuid.uuid4().hex}.jsonl"
                if kept:
                    stores.write(stores.below(self.folder, name), b"\n".join(kept) + b"\n")
            if room:
                delivered.append(name)
                pushed += room
        claimed = offered if self.cap is None else min(offered, self.cap)
        manifest = {
            "rows_offered": offered,
            "rows_delivered": pushed,
            "rows_given_back": claimed - pushed,
            "cap_reached": self.cap is not None and offered > self.cap,
            "budget_reached": pushed < claimed,
            "complete": pushed == offered,
            "batches": delivered,
        }
        stores.write(stores.below(self.folder, MANIFEST), json.dumps(manifest).encode())

    def abort(self, messages: list[Pushed | None]) -> None:
        for name, _ in (b for m in messages if m for b in m.batches):
            stores.remove(stores.below(self.folder, name))


class CappedPush(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "capped_push"

    def writer(self, schema, overwrite: bool) -> CappedWriter:
        return CappedWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CappedPush)


def push(rows: DataFrame, path: str, cap: int, budget: int | None = None, batch_rows: int = 500) -> dict:
    """Deliver at most ``cap`` rows to a new folder; what was offered, delivered and given back.

    Which rows a cap leaves out follows the partitions' order; sort first where
    that matters.
    """
    register(rows.sparkSession)
    options = {"path": path, "cap": cap, "batch_rows": batch_rows} | ({} if budget is None else {"budget": budget})
    rows.write.format("capped_push").options(**options).mode("append").save()
    return delivery(path)


def delivery(path: str) -> dict:
    found = stores.whole(stores.below(path, MANIFEST))
    if found is None:
        raise FileNotFoundError(f"nothing was delivered to {path}")
    return json.loads(found)


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the manifest names."""
    names = [stores.below(path, n) for n in delivery(path)["batches"]]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
