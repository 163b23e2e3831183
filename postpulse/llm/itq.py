"""Operator 10: embedding near-duplicates through ITQ codes and Hamming tables.

Iterative quantisation turns principal components into balanced binary codes:
a rotation is learned so that the signs stay as close to the projections as
they can.  A code has 64 bits; vectors with fewer components take them from
several rotations.  Two codes are cut into short substrings, each
with a table of its own; near vectors differ in at most one bit of some
substring with high probability, so each vector is stored once for each table
and looked up under its substring and all one-bit changes of it.  What two
whole codes leave plausible is decided by the cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import materialized, picked
from postpulse.llm.graph import components, joined_up
from postpulse.llm.vectors import lengths, matrix, sample_rows, usable

#: Vectors that the rotations are learned from at most.
FIT_ROWS = 10_000
N_CODES = 2
CODE_BITS = 64
SUBSTRING_BITS = 16
#: Stored rows that a task compares at a time; fuller buckets are split.
BLOCK_ROWS = 4096
SALT_BITS = 20


@dataclass(frozen=True)
class Codes:
    """Each matrix maps a centred unit vector to the 64 signs of its columns."""

    centre: np.ndarray
    signs: tuple[np.ndarray, ...]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One unsigned 64-bit number for each code, by column."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.centre
        out = []
        for columns in self.signs:
            bits = (unit @ columns > 0).view(np.uint8)
            out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0])
        return np.column_stack(out).astype(np.uint64)


def learn(sample: np.ndarray, n_codes: int = N_CODES, rounds: int = 40, seed: int = 5) -> Codes:
    """PCA, then for each rotation alternate between signs and the best rotation to them.

    The centre is drawn to the origin by as many vectors as there are
    components, since few vectors say little about it (centred by their own
    mean, two near ones are opposites).
    """
    width = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.sum(axis=0) / (len(unit) + width)
    _, vectors = np.linalg.eigh((unit - centre).T @ (unit - centre))
    basis = vectors[:, ::-1][:, :CODE_BITS]
    projected = (unit - centre) @ basis
    draw = np.random.default_rng(seed)

    def rotation() -> np.ndarray:
        turn, _ = np.linalg.qr(draw.normal(size=(basis.shape[1],) * 2))
        for _ in range(rounds):
            signs = np.where(projected @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            turn = left @ right
        return basis @ turn

    each = -(-CODE_BITS // basis.shape[1])
    found = [np.column_stack([rotation() for _ in range(each)]) for _ in range(n_codes)]
    return Codes(centre, tuple(columns[:, :CODE_BITS] for columns in found))


def plausible_bits(cosine: float, bits: int) -> int:
    """Differing bits that pairs at ``cosine`` stay within: the mean and six deviations."""
    p = float(np.arccos(cosine) / np.pi)
    return int(np.ceil(bits * p + 6 * np.sqrt(bits * p * (1 - p))))


def _postings(rows: DataFrame, codes: Codes) -> DataFrame:
    """key, probe, id, c0..: each row stored once and looked up 1 + bits times for each table."""
    n_codes, width = len(codes.signs), len(codes.centre)
    tables = CODE_BITS // SUBSTRING_BITS
    flips = np.array([0, *(1 << k for k in range(SUBSTRING_BITS))], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = codes.encode(matrix(batch.column(1), width))
            ids = batch.column(0).to_numpy()
            for c in range(n_codes):
                for t in range(tables):
                    sub = found[:, c] >> np.uint64(SUBSTRING_BITS * t)
                    sub = (sub & np.uint64((1 << SUBSTRING_BITS) - 1)).astype(np.int64)
                    key = ((c * tables + t) << SUBSTRING_BITS) | (sub[:, None] ^ flips)
                    key = np.column_stack([key[:, 0], key])
                    probe = np.ones(key.shape, dtype=bool)
                    probe[:, 0] = False
                    times = key.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.ravel()),
                            pa.array(probe.ravel()),
                            pa.array(np.repeat(ids, times)),
                            *[
                                pa.array(np.repeat(found[:, k], times).view(np.int64))
                                for k in range(n_codes)
                            ],
                        ],
                        names=["key", "probe", "id", *(f"c{k}" for k in range(n_codes))],
                    )

    fields = ", ".join(f"c{k} long" for k in range(n_codes))
    return rows.mapInArrow(run, f"key long, probe boolean, id long, {fields}")


def _salted(postings: DataFrame) -> DataFrame:
    """``postings`` with crowded buckets split into blocks of some ``BLOCK_ROWS`` stored rows.

    A stored row goes to one block of its bucket, lookups to all of them.
    Buckets are numbered by code, table and substring, some 524,000 in all
    whatever the rows, which bounds the crowded ones that are broadcast.
    """
    stored = postings.where(~F.col("probe")).groupBy("key").agg(F.count("*").alias("n"))
    crowded = stored.where(F.col("n") > BLOCK_ROWS).select(
        F.col("key").alias("crowded"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")
    )
    joined = postings.join(F.broadcast(crowded), F.col("key") == F.col("crowded"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("id"), blocks))
    salts = F.when(F.col("probe"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own)
    rest = [c for c in postings.columns if c != "key"]
    rows = joined.select("key", F.explode(salts).alias("salt"), *rest)
    key = F.shiftleft("key", SALT_BITS).bitwiseOR(F.col("salt"))
    return rows.withColumn("key", key).drop("salt")


def _blocks(
    batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], list[np.ndarray]]
) -> Iterator[tuple[int, bool, list[np.ndarray]]]:
    """Runs of rows with one key and side, as slices of what ``arrays`` makes of a batch.

    The input is sorted by both.  A batch is converted once, as most runs are short.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        probe = batch.column(1).to_numpy(zero_copy_only=False)
        columns = arrays(batch)
        change = (np.diff(keys) != 0) | (np.diff(probe.astype(np.int8)) != 0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]
        firsts = np.array(edges[:-1])
        runs = zip(edges[:-1], edges[1:], keys[firsts].tolist(), probe[firsts].tolist(), strict=True)
        for low, high, key, side in runs:
            yield key, side, [c[low:high] for c in columns]


def _plausible(
    number: int, ids: np.ndarray, own: np.ndarray, others: np.ndarray, code: np.ndarray, most: int
) -> np.ndarray:
    """Which stored rows (by row) and lookups (by column) are a pair to check here.

    The smaller id is the stored one, the codes differ in at most ``most`` bits
    in all, and no earlier table brings the two together.
    """
    tables = CODE_BITS // SUBSTRING_BITS
    bits = sum(
        np.bitwise_count(own[:, None, k] ^ code[None, :, k]).astype(np.int16)
        for k in range(own.shape[1])
    )
    pairs = (bits <= most) & (ids[:, None] < others[None, :])
    i, j = np.nonzero(pairs)
    if len(i) and number:
        lowest = np.uint64((1 << SUBSTRING_BITS) - 1)
        met = np.zeros(len(i), dtype=bool)
        for earlier in range(number):
            c, t = divmod(earlier, tables)
            sub = (own[i, c] ^ code[j, c]) >> np.uint64(SUBSTRING_BITS * t)
            met |= np.bitwise_count(sub & lowest) <= 1
        pairs[i[met], j[met]] = False
    return pairs


def _members(rows: DataFrame, codes: Codes, most_bits: int) -> DataFrame:
    """key, probe, id: in each block, the rows that have somebody to be checked against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, own, found = None, [], [], None

        def members(key: int, probe: bool, kept: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(kept), key)),
                    pa.array(np.full(len(kept), probe)),
                    pa.array(kept),
                ],
                names=["key", "probe", "id"],
            )

        def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
            code = np.column_stack([c.to_numpy() for c in batch.columns[3:]]).view(np.uint64)
            return [batch.column(2).to_numpy(), code]

        for key, probe, (part, code) in _blocks(batches, arrays):
            if key != now:
                if found is not None and found.any():
                    yield members(now, False, ids[0][found])
                now, ids, own, found = key, [], [], None
            if not probe:
                ids.append(part)
                own.append(code)
                continue
            if not ids:
                continue
            if found is None:
                ids, own = [np.concatenate(ids)], [np.concatenate(own)]
                found = np.zeros(len(ids[0]), dtype=bool)
            step = max(1, (1 << 21) // len(ids[0]))
            for low in range(0, len(part), step):
                looked, theirs = part[low : low + step], code[low : low + step]
                number = key >> (SUBSTRING_BITS + SALT_BITS)
                pairs = _plausible(number, ids[0], own[0], looked, theirs, most_bits)
                found |= pairs.any(axis=1)
                some = pairs.any(axis=0)
                if some.any():
                    yield members(key, True, looked[some])
        if found is not None and found.any():
            yield members(now, False, ids[0][found])

    runs = _salted(_postings(rows, codes)).repartition("key").sortWithinPartitions("key", "probe")
    return runs.mapInArrow(run, "key long, probe boolean, id long")


def _links(
    members: DataFrame, classes: DataFrame, codes: Codes, most_bits: int, cosine: float
) -> DataFrame:
    """a, b, n: with b null, n of a's links; else an edge of the link graph's components.

    Cosines are taken block by block between original vectors; a block reports
    sums and a spanning forest, never its pairs, so a group of near copies
    costs rows in proportion to its size.
    """
    width = len(codes.centre)

    def report(sums: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        some = sums > 0
        nodes, ends = edges[:, 0], edges[:, 1]
        missing = np.concatenate([np.ones(int(some.sum()), bool), np.zeros(len(ends), bool)])
        b = np.concatenate([np.zeros(int(some.sum()), np.int64), ends])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], nodes])),
                pa.array(b, mask=missing),
                pa.array(np.concatenate([sums[some], np.zeros(len(ends), np.int64)])),
            ],
            names=["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
            vectors = matrix(batch.column(4), width)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            ids, sizes = (batch.column(k).to_numpy() for k in (2, 3))
            return [ids, sizes, codes.encode(vectors), unit]

        for key, probe, part in _blocks(batches, arrays):
            if key != now:
                now, held, ready = key, [], None
            if not probe:
                held.append(part)
                continue
            if not held:
                continue
            if ready is None:
                ready = [np.concatenate(x) for x in zip(*held, strict=True)]
            ids, sizes, own, unit = ready
            step = max(1, (1 << 21) // len(ids))
            for low in range(0, len(part[0]), step):
                others, counts, code, points = (x[low : low + step] for x in part)
                number = key >> (SUBSTRING_BITS + SALT_BITS)
                found = _plausible(number, ids, own, others, code, most_bits)
                found &= unit @ points.T >= cosine
                if found.any():
                    edges = joined_up(found, ids, others)
                    yield report(found @ counts, ids, edges)
                    yield report(found.T @ sizes, others, edges[:0])

    vectors = classes.select(F.col("id").alias("of"), "n", "embedding")
    rows = members.join(vectors, F.col("id") == F.col("of"))
    rows = rows.select("key", "probe", "id", "n", "embedding")
    runs = rows.repartition("key").sortWithinPartitions("key", "probe")
    return runs.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    df: DataFrame,
    cosine: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, n_links and component_id of every row.

    Every row is a vector of its own, whether or not rows share an id or have
    none.  Vectors that are null or zero or hold null or non-finite components
    link with nothing, others with vectors of their own length; each length has
    an index of its own.  Equal vectors collapse to one class first (its
    smallest id, its size), so copies are counted, never paired.
    ``component_id`` is the smallest id that a row's links reach (null where
    none of them has one).  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = materialized(picked(df, id=id_col, embedding=vector_col), "vectors")
    able = rows.where(usable())
    classes = able.groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # Classes have numbers of their own, as an id may stand at several of them.
    numbered = classes.withColumn("id", F.monotonically_increasing_id())
    classes = materialized(numbered, "classes")
    most = plausible_bits(cosine, N_CODES * CODE_BITS)
    found = spark.createDataFrame([], "a long, b long, n long")
    for width, _ in lengths(classes):
        own = classes.where(F.size("embedding") == width)
        codes = learn(sample_rows(own, FIT_ROWS, width, by="embedding"))
        members = _members(own.select("id", "embedding"), codes, most)
        found = found.union(materialized(_links(members, own, codes, most, cosine), "links"))
    degrees = (
        found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    )
    linked = components(found.where("b is not null").select("a", "b"))
    ids = classes.select(F.col("id").alias("node"), "least")
    reached = (
        linked.join(ids, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    )
    facts = (
        classes.join(degrees.toDF("d_id", "others"), F.col("id") == F.col("d_id"), "left")
        .join(linked, F.col("id") == F.col("node"), "left")
        .join(reached, "component", "left")
        .select(
            F.col("embedding").alias("vector"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("least"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    )
    items = able.join(facts, F.col("embedding") == F.col("vector")).select(
        "id", "n_links", "component_id"
    )
    others = rows.where(~F.coalesce(usable(), F.lit(False)))
    return items.union(
        others.select("id", F.lit(0).cast("long"), F.col("id").alias("component_id"))
    )
