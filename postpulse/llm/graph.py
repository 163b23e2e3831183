"""Connected components of an edge list, by alternating star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import drop_path, fresh_path, written


def _signature(edges: DataFrame) -> tuple:
    # A sum of hashes, kept in decimals so that it cannot overflow.
    mix = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(mix).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node it reaches) for every node with an edge.

    ``edges`` has two bigint columns; direction, repeats and loops do not
    matter.  Each round lets every node hand its larger neighbours, then its
    smaller ones, to the smallest node it sees; rounds grow with the logarithm
    of a component's size.  Both steps are partially aggregated minima and an
    equi-join that adaptive execution may split, so a hub is no single task's
    burden, and each round is a table in the shared folder, which goes once the
    next is written.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    path = fresh_path(spark, "edges")
    current = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        path,
    )
    before = _signature(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.join(least, F.col("u") == F.col("k"))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        between = fresh_path(spark, "large-star")
        large = written(large, between)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("k"), "m")
        small = (
            large.join(least, F.col("u") == F.col("k"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        done, path = path, fresh_path(spark, "small-star")
        current = written(small.union(least.select("k", "m")).distinct().toDF("u", "v"), path)
        for old in (done, between):
            drop_path(spark, old)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select("v").distinct().select("v", F.col("v").alias("component"))
    return current.union(roots).toDF("node", "component")


def joined_up(links: np.ndarray, ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Edges (two columns) that connect what ``links`` connects, one less than its nodes.

    ``links`` has a row for each of ``ids`` and a column for each of ``others``.
    """
    rows, columns = ids.copy(), others.copy()
    top = np.iinfo(ids.dtype).max
    while True:
        new_columns = np.minimum(columns, np.where(links, rows[:, None], top).min(axis=0))
        new_rows = np.minimum(rows, np.where(links, new_columns[None, :], top).min(axis=1))
        if (new_rows == rows).all() and (new_columns == columns).all():
            break
        rows, columns = new_rows, new_columns
    edges = np.concatenate([np.column_stack([ids, rows]), np.column_stack([others, columns])])
    return edges[edges[:, 0] != edges[:, 1]]
