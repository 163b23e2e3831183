"""Pieces that the corpus operators share.

Null conventions used throughout: a null text counts as the empty text, a
null id is kept and comes back null, repeated rows stay repeated, columns
other than those named are ignored (so their names cannot clash).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only word separator the operators know.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the names the operator works with."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


#: Bytes of texts that a worker turns into Python objects at a time, one longer text at least.
SLICE_BYTES = 4 << 20


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` at most, or of one larger item."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's strings and binary values."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes


def map_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | T.StructType,
) -> DataFrame:
    """``work`` over each Arrow batch, cut into slices of bounded size; it sees whole rows and no partition state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(text_bytes(batch), SLICE_BYTES):
                if (out := work(batch.slice(start, end - start))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def unused_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores behind it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_given: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``cleared`` deletes what was given out inside it."""
    _given.append(f"{shared_dir(spark)}/postpulse/{label}-{uuid.uuid4().hex}")
    return _given[-1]


def materialized(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that ran there, not
    the stages before the table.  Results read from it; ``cleared`` deletes it.
    """
    return written(df, fresh_path(df.sparkSession, label), **options)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving all tables and files written to fresh paths inside.

    Write what you need of the results before.
    """
    before = len(_given)
    try:
        yield
    finally:
        while len(_given) > before:
            drop_path(spark, _given.pop())


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spans_text(spans) -> F.Column:
    """``kind:start:end`` joined by commas, in the array's own order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def span_digest(found: DataFrame, base: tuple[str, ...], *more: F.Column) -> DataFrame:
    """doc_id, one count for each base kind, base_sha256, spans and ``more``."""
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(of_base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        *more,
    )
