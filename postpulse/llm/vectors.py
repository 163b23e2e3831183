"""Vector columns: which rows take part, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> F.Column:
    """Holds for vectors without null or non-finite components that are not all zero."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def lengths(df: DataFrame, column: str = "embedding") -> list[tuple[int, int]]:
    """(length, rows) of each length with two vectors at least, commonest first (ties: the longest)."""
    sizes = df.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.where("n > 1").orderBy(F.desc("n"), F.desc("d")).collect()
    return [(int(r["d"]), int(r["n"])) for r in found]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of length ``width``, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, width)


def sample_rows(df: DataFrame, most: int, width: int, by: str = "id") -> np.ndarray:
    """At most ``most`` vectors (column embedding) whose ``by`` have the smallest hashes."""
    kept = df.orderBy(F.xxhash64(by), by, "embedding").limit(most).select("embedding").toArrow()
    if not kept.num_rows:
        return np.zeros((0, width))
    return matrix(kept["embedding"].combine_chunks(), width)
