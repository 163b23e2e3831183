"""Operator 3: nearest neighbours by a forest of random-projection trees.

Largest inner product becomes a search around the origin of directions by one
more coordinate, which gives all stored vectors the same length (it is 0 for
queries).  Trees split at the median along the difference of two random
vectors.  A query walks all trees with one priority queue, ordered by how far
beyond a split a branch lies, until the leaves visited cover a share of the
table; every vector in those leaves is a candidate, and candidates are ranked
by their exact inner products.

The share is learned from the sample that the splits are fitted on: the one at
which its own queries reach the wanted part of their nearest rows.  Vectors
with structure need little of the table, independent directions about half.

Each vector is stored once, in a block of rows that are close in the first
tree, with its leaves in all trees.  A query goes to the blocks that hold rows
of its leaves, once each, with the set of leaves it visits, so that a candidate
found in several trees is scored once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import materialized, picked
from postpulse.llm.vectors import lengths, matrix, sample_rows, usable

#: Vectors that the splits are fitted on at most; every vector is indexed.
FIT_ROWS = 10_000
TREES = 16
DEPTH = 9
#: Sampled vectors of a leaf at least, on average.
LEAF_SAMPLE = 16
#: Rows of a block, which one task holds at a time.
BLOCK_ROWS = 4096
#: Part of their nearest rows that the sample's queries reach, and how many ask.
RECALL = 0.94
TRIALS = 128
#: Of a block's rows, the share of candidates above which all are multiplied at once.
DENSE = 1 / 8


@dataclass(frozen=True)
class Forest:
    """Splits in heap order by tree: directions and thresholds."""

    directions: np.ndarray
    thresholds: np.ndarray
    depth: int
    longest: float

    @property
    def leaf_count(self) -> int:
        return 1 << self.depth

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.longest**2 - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0))])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, by column."""
        points = self.lifted(vectors)
        out = np.zeros((len(points), len(self.directions)), dtype=np.int64)
        for t, (ways, cuts) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            node = np.zeros(len(points), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", points, ways[node]) > cuts[node]
                node = 2 * node + 1 + side
            out[:, t] = node - (self.leaf_count - 1)
        return out

    def offsets(self, queries: np.ndarray) -> np.ndarray:
        """How far each query lies beyond each split, by tree and node."""
        points = np.column_stack([queries, np.zeros(len(queries))])
        return np.einsum("qd,tnd->qtn", points, self.directions, optimize=True) - self.thresholds

    def walk(self, offsets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(tree, leaf, share covered so far, rows seen in one tree) in the shared queue's order.

        ``offsets`` are one query's, ``sizes`` the rows of each leaf by tree.
        Trees are taken to miss rows independently of each other.
        """
        splits = self.leaf_count - 1
        total = max(1, int(sizes[0].sum()))
        seen, missed = [0] * len(sizes), [1.0] * len(sizes)
        beyond_by, size_by = offsets.tolist(), sizes.tolist()
        queue = [(0.0, t, 0) for t in range(len(sizes))]
        most = 0
        while queue:
            beyond, t, node = heapq.heappop(queue)
            own = beyond_by[t]
            while node < splits:
                offset = own[node]
                near = 2 * node + 1 + (offset > 0)
                heapq.heappush(queue, (max(beyond, abs(offset)), t, 4 * node + 3 - near))
                node = near
            rows = size_by[t][node - splits]
            if rows:
                seen[t] += rows
                missed[t] = 1 - seen[t] / total
                most = max(most, seen[t])
                share = 1.0
                for part in missed:
                    share *= part
                yield t, node - splits, 1 - share, most

    def visits(
        self, offsets: np.ndarray, sizes: np.ndarray, coverage: float, least: int
    ) -> list[int]:
        """tree x leaves + leaf of what a query visits: ``coverage`` and ``least`` rows for certain."""
        found = []
        least = min(least, int(sizes[0].sum()))
        for t, leaf, share, most in self.walk(offsets, sizes):
            found.append(t * self.leaf_count + leaf)
            if share >= coverage - 1e-12 and most >= least:
                break
        return found


def grow(sample: np.ndarray, longest: float, trees: int, depth: int, seed: int = 3) -> Forest:
    """Fit the splits; depth shrinks until a leaf holds some ``LEAF_SAMPLE`` sampled vectors."""
    while depth and len(sample) < LEAF_SAMPLE << depth:
        depth -= 1
    width = sample.shape[1] + 1
    splits = (1 << depth) - 1
    forest = Forest(np.zeros((trees, splits, width)), np.zeros((trees, splits)), depth, longest)
    points = forest.lifted(sample)
    draw = np.random.default_rng(seed)
    for t in range(trees):
        members = {0: np.arange(len(points))}
        for node in range(splits):
            own = members.pop(node)
            pair = points[draw.choice(own, 2, replace=False)]
            way = pair[0] - pair[1]
            norm = np.linalg.norm(way)
            way = way / norm if norm > 0 else draw.normal(size=width)
            along = points[own] @ way
            cut = np.median(along)
            forest.directions[t, node], forest.thresholds[t, node] = way, cut
            members[2 * node + 1], members[2 * node + 2] = own[along <= cut], own[along > cut]
            for child in (2 * node + 1, 2 * node + 2):
                if len(members[child]) < 2:  # equal vectors: split the node's rows anyhow
                    members[child] = own
    return forest


def leaf_sizes(forest: Forest, leaves: np.ndarray) -> np.ndarray:
    """Rows of each leaf by tree."""
    return np.stack([np.bincount(own, minlength=forest.leaf_count) for own in leaves.T])


def learned_coverage(
    forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS
) -> float:
    """The share of the table at which the sample's queries reach ``recall`` of their nearest rows.

    The nearest rows of a whole table lie nearer than those of a sample, so
    what the sample needs is enough for the table.
    """
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    leaves = forest.leaves(sample)
    sizes = leaf_sizes(forest, leaves)
    chosen = np.random.default_rng(9).permutation(len(sample))[:trials]
    offsets = forest.offsets(sample[chosen])
    trees = np.arange(leaves.shape[1])
    needed = []
    for query, own in zip(chosen.tolist(), offsets, strict=True):
        scores = sample @ sample[query]
        scores[query] = -np.inf
        nearest = np.argpartition(-scores, k - 1)[:k]
        reached = np.ones(sizes.shape)
        for t, leaf, share, _ in forest.walk(own, sizes):
            reached[t, leaf] = share
        needed.append(reached[trees, leaves[nearest]].min(axis=1))
    return float(np.quantile(np.concatenate(needed), recall, method="higher"))


def blocks_of(first_tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each leaf of the first tree.

    Neighbouring leaves share a block while it holds ``BLOCK_ROWS`` rows; a
    fuller leaf has blocks of its own.
    """
    first = np.zeros(len(first_tree), dtype=np.int64)
    count = np.maximum(1, -(-first_tree // BLOCK_ROWS))
    block, held = 0, 0
    for leaf, (size, own) in enumerate(zip(first_tree.tolist(), count.tolist(), strict=True)):
        if held and held + size > BLOCK_ROWS:
            block, held = block + 1, 0
        first[leaf] = block
        if own > 1:
            block, held = block + own, 0
        else:
            held += size
    return first, count


def candidates(seen: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Which rows (by column) have a leaf that a query (by row) visits, in any tree.

    ``seen`` tells for each query, tree and leaf whether it is visited.
    """
    found = np.zeros((len(seen), len(leaves)), dtype=bool)
    for t in range(leaves.shape[1]):
        found |= np.take(seen[:, t], leaves[:, t], axis=1)
    return found


def _ranked(
    ids: np.ndarray, rows: np.ndarray, q: np.ndarray, p: np.ndarray, mask: np.ndarray, k: int
) -> tuple[np.ndarray, ...]:
    """Of each query, its ``k`` best rows by ``mask``: exact scores, ties to the smaller id."""
    rough = np.where(mask, p @ rows.T, -np.inf)
    if rough.shape[1] > k:
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    else:
        floor = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
    i, j = np.nonzero((rough >= (floor - slack)[:, None]) & mask)
    score = (p[i] * rows[j]).sum(axis=1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return q[i[keep]], ids[j[keep]], score[keep]


def _best(
    ids: np.ndarray,
    numbers: np.ndarray,
    rows: np.ndarray,
    asking: np.ndarray,
    p: np.ndarray,
    mask: np.ndarray,
    k: int,
) -> Iterator[tuple[np.ndarray, ...]]:
    """``_ranked`` for many queries (by place); one with few candidates multiplies only those.

    ``numbers`` are the rows', ``asking`` the queries' own: no row is its own neighbour.
    """
    mask = mask & (asking[:, None] != numbers[None, :])
    q = np.arange(len(asking))
    few = mask.mean(axis=1) < DENSE
    if not few.all():
        yield _ranked(ids, rows, q[~few], p[~few], mask[~few], k)
    for n in np.flatnonzero(few).tolist():
        own = np.flatnonzero(mask[n])
        if len(own):
            every = np.ones((1, len(own)), dtype=bool)
            yield _ranked(ids[own], rows[own], q[n : n + 1], p[n : n + 1], every, k)


_POSTING = "key long, probe boolean, id long, number long, vector binary, marks binary"


def _cells(values: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    content = np.ascontiguousarray(values).tobytes()
    width = len(content) // max(1, len(values))
    offsets = np.arange(0, len(content) + 1, max(1, width), dtype=np.int32)[: len(values) + 1]
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(content)]
    )


def _postings(
    keys, probe: bool, ids, numbers, vectors: np.ndarray, marks: np.ndarray
) -> pa.RecordBatch:
    sides = pa.array(np.full(len(ids), probe))
    columns = [pa.array(keys), sides, pa.array(ids), pa.array(numbers), _cells(vectors), _cells(marks)]
    return pa.RecordBatch.from_arrays(
        columns, names=["key", "probe", "id", "number", "vector", "marks"]
    )


def neighbours(
    df: DataFrame,
    is_query: F.Column,
    k: int = 20,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest found of every query row.

    ``is_query`` is a condition on column ``id``.  Vectors that are null or
    zero or hold null or non-finite components take no part, nor do null ids.
    Neighbours have the query's length; each length has a forest of its own.
    Every row takes part, also where rows share an id: each of them asks for
    itself and may be the others' neighbour.  Equal scores go by the smaller
    id.  A query without any other row, or an empty table, gives no rows.
    """
    rows = picked(df, id=id_col, embedding=vector_col)
    rows = rows.where(F.col("id").isNotNull() & usable())
    numbered = rows.withColumns(
        {"id": F.col("id").cast("long"), "number": F.monotonically_increasing_id()}
    )
    rows = materialized(numbered, "vectors")
    found = [
        _of_length(rows.where(F.size("embedding") == width), is_query, k, trees, depth, recall, width)
        for width, _ in lengths(rows)
    ]
    if not found:
        schema = "query_id long, rank int, id long, score double"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, found)


def _leaf_table(rows: DataFrame, forest: Forest, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each leaf by tree, and for each leaf which leaves of the first tree it meets.

    Both are sums over all rows, of a size that trees and leaves bound.
    """
    trees, leaves = len(forest.directions), forest.leaf_count
    words = max(1, leaves // 64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(trees * leaves, dtype=np.int64)
        meets = np.zeros((trees * leaves, words * 64), dtype=bool)
        for batch in batches:
            if batch.num_rows:
                own = forest.leaves(matrix(batch.column(1), width))
                keys = own + np.arange(trees) * leaves
                sums += np.bincount(keys.ravel(), minlength=len(sums))
                meets[keys, own[:, :1]] = True
        some = np.flatnonzero(sums)
        packed = np.packbits(meets[some], axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(sums[some]), *[pa.array(w.copy()) for w in packed.T]],
            names=["leaf", "n", *(f"w{k}" for k in range(words))],
        )

    fields = ", ".join(f"w{k} long" for k in range(words))
    counted = rows.mapInArrow(tally, f"leaf long, n long, {fields}").groupBy("leaf")
    ors = [F.bit_or(f"w{k}").alias(f"w{k}") for k in range(words)]
    sizes = np.zeros(trees * leaves, dtype=np.int64)
    meets = np.zeros((trees * leaves, words), dtype=np.int64)
    for row in counted.agg(F.sum("n").alias("n"), *ors).collect():  # trees x leaves rows
        sizes[row["leaf"]] = row["n"]
        meets[row["leaf"]] = row[2:]
    return sizes.reshape(trees, leaves), meets


def _of_length(
    rows: DataFrame,
    is_query: F.Column,
    k: int,
    trees: int,
    depth: int,
    recall: float,
    width: int,
) -> DataFrame:
    """``neighbours`` among ``rows`` (columns id, embedding, number), all vectors of length ``width``."""
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    longest = float(rows.agg(F.max(squares)).first()[0]) ** 0.5
    sample = sample_rows(rows, FIT_ROWS, width)
    forest = grow(sample, longest, trees, depth)
    coverage = learned_coverage(forest, sample, k, recall)
    leaves = forest.leaf_count
    sizes, meets = _leaf_table(rows, forest, width)
    first, count = blocks_of(sizes[0])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
            numbers = batch.column(2).to_numpy()
            own = forest.leaves(points)
            # Rows spread over a full leaf's blocks by a mixed number.
            mixed = (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = mixed % count[own[:, 0]].astype(np.uint64)
            keys = first[own[:, 0]] + block.astype(np.int64)
            yield _postings(keys, False, ids, numbers, points, own.astype(np.uint16))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                points, ids = matrix(part.column(1), width), part.column(0).to_numpy()
                numbers = part.column(2).to_numpy()
                seen = np.zeros((len(ids), trees * leaves), dtype=bool)
                keys: list[np.ndarray] = []
                for n, offsets in enumerate(forest.offsets(points)):
                    found = forest.visits(offsets, sizes, coverage, k + 1)
                    seen[n, found] = True
                    near = np.bitwise_or.reduce(meets[found], axis=0).view(np.uint8)
                    roots = np.flatnonzero(np.unpackbits(near, bitorder="little"))
                    spans = [np.arange(first[r], first[r] + count[r]) for r in roots.tolist()]
                    keys.append(np.unique(np.concatenate(spans)))
                marks = np.packbits(seen, axis=1, bitorder="little")
                for n, own in enumerate(keys):
                    for at in range(0, len(own), 2000):
                        to = own[at : at + 2000]
                        yield _postings(
                            to,
                            True,
                            np.repeat(ids[n : n + 1], len(to)),
                            np.repeat(numbers[n : n + 1], len(to)),
                            np.repeat(points[n : n + 1], len(to), axis=0),
                            np.repeat(marks[n : n + 1], len(to), axis=0),
                        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key, stored rows before queries: hold a block, stream its queries."""
        now, held, ready = None, [], None

        def cells(column: pa.Array, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)

        def stored(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            vectors = cells(part.column(4), np.float64).reshape(-1, width)
            marks = cells(part.column(5), np.uint16).reshape(-1, trees)
            return part.column(2).to_numpy(), part.column(3).to_numpy(), vectors, marks

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, probe = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = (np.diff(keys) != 0) | (np.diff(probe.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if keys[low] != now:
                    now, held, ready = keys[low], [], None
                if not probe[low]:
                    held.append(stored(batch.slice(low, high - low)))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held, strict=True)]
                ids, numbers, vectors, own = ready
                for at in range(low, high, 256):
                    part = batch.slice(at, min(256, high - at))
                    queries, asking = part.column(2).to_numpy(), part.column(3).to_numpy()
                    points = cells(part.column(4), np.float64).reshape(-1, width)
                    packed = cells(part.column(5), np.uint8).reshape(len(queries), -1)
                    seen = np.unpackbits(packed, axis=1, bitorder="little", count=trees * leaves)
                    mask = candidates(seen.view(bool).reshape(-1, trees, leaves), own)
                    for n, other, score in _best(ids, numbers, vectors, asking, points, mask, k):
                        columns = (asking[n], queries[n], other, score)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c) for c in columns], names=["number", "query_id", "id", "score"]
                        )

    postings = rows.mapInArrow(store, _POSTING).union(rows.where(is_query).mapInArrow(ask, _POSTING))
    met = (
        postings.repartition("key")
        .sortWithinPartitions("key", "probe")
        .mapInArrow(meet, "number long, query_id long, id long, score double")
    )
    order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
