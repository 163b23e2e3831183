"""Places in a descending order, without sorting everything in one task."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows with the smallest hashes that bounds are chosen from, and bounds.
SAMPLE, BOUNDS = 4096, 256


def with_place(rows: DataFrame, size: str, name: str = "board", into: str = "place") -> DataFrame:
    """``rows`` with their place from 0: ``size`` descending, then ``name``.

    Bounds from a bounded sample cut the order into ranges; a range's place is
    that of its first row, and rows are numbered within it.  Bounds are values,
    so a recomputed task cuts where the first one did.  Null sizes come last;
    ``size`` is a whole number.
    """
    key = F.struct(
        F.coalesce(-F.col(size).cast("long"), F.lit((1 << 63) - 1)).alias("s"),
        F.coalesce(F.col(name).cast("string"), F.lit("")).alias("n"),
    )
    sample = rows.select(key.alias("k")).orderBy(F.xxhash64("k.n", "k.s"), "k").limit(SAMPLE)
    found = sorted((r["k"]["s"], r["k"]["n"].encode(), r["k"]["n"]) for r in sample.collect())
    step = max(1, len(found) // BOUNDS)
    bounds = [{"s": s, "n": n} for s, _, n in found[step::step]]
    table = F.from_json(F.lit(json.dumps(bounds)), "array<struct<s:bigint,n:string>>")
    cut = rows.withColumn("_range", F.size(F.filter(table, lambda b: b <= key)))
    counts = cut.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    # One row for each of at most some five hundred ranges.
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_range").orderBy(F.desc(size), name)
    placed = cut.withColumn("_row", F.row_number().over(own) - 1)
    placed = placed.join(firsts, F.col("_range") == F.col("_of"))
    return placed.withColumn(into, F.col("_first") + F.col("_row")).drop("_range", "_of", "_first", "_row")
