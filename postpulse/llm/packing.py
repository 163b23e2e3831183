"""Operator 4: documents packed into fixed-length sequences, sum-of-squares style."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import map_batches, materialized, picked
from postpulse.llm.tokens import END_ID, ID_BYTES, default_tokenizer, encoder

CAPACITY = 2048
#: Pieces packed together by one task.  Open bins at the end of a group are
#: the only loss against packing all at once, a few dozen in this many.
GROUP_PIECES = 50_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given.

    An item goes where the sum over residual gaps of the squared number of
    open bins with that gap becomes smallest (ties: the tightest gap).  Full
    bins do not count.
    """
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    used = 0
    never = np.int64(1) << 60
    for k, size in enumerate(lengths.tolist()):
        here = open_bins[size:capacity]
        gap = capacity
        if len(here):
            # Twice the change of the sum, halved: gap g loses a bin, g - size gains one.
            cost = np.where(here > 0, 2 * (open_bins[: capacity - size] - here) + 2, never)
            if here[0]:
                cost[0] = 1 - 2 * here[0]
            best = int(cost.argmin())
            anew = 2 * open_bins[capacity - size] + 1
            if cost[best] <= anew:
                gap = size + best
        if gap == capacity:
            target, used = used, used + 1
        else:
            target = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[k], offsets[k] = target, capacity - gap
        if gap > size:
            stacks[gap - size].append(target)
            open_bins[gap - size] += 1
    return bins, offsets


def packing_order(lengths: np.ndarray, capacity: int, seed: int = 9) -> np.ndarray:
    """Pieces over an eighth of a sequence, longest first, then the others in random order.

    Long pieces leave gaps of every size and short ones, mixed, keep the
    counts of gaps low, which is what the rule is good at: it then needs
    hardly more sequences than the ids fill.
    """
    long = np.flatnonzero(lengths > capacity // 8)
    short = np.flatnonzero(lengths <= capacity // 8)
    long = long[np.argsort(-lengths[long], kind="stable")]
    return np.concatenate([long, np.random.default_rng(seed).permutation(short)])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    df: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document with its end id, cut."""
    path = tokenizer or default_tokenizer()
    rows = picked(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, end = encoder(path).encode, END_ID.to_bytes(ID_BYTES, "little")
        owner, number, start, length, check, content = [], [], [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids = encode(text or "") + end
            for p, (s, n) in enumerate(cut(len(ids) // ID_BYTES, capacity)):
                part = ids[s * ID_BYTES : (s + n) * ID_BYTES]
                owner.append(k)
                number.append(p)
                start.append(s)
                length.append(n)
                check.append(zlib.crc32(part))
                if with_ids:
                    content.append(part)
        columns = [
            batch.column(0).take(pa.array(owner, type=pa.int64())),
            pa.array(number, type=pa.int32()),
            *[pa.array(c, type=pa.int64()) for c in (start, length, check)],
            *[pa.array(content, type=pa.binary())] * with_ids,
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids binary" * with_ids
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}"
    return map_batches(rows, work, schema)


def pack(
    cuts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """``cuts`` with sequence_id and offset; ``length`` is at most ``capacity``.

    Pieces are dealt evenly to groups, whatever their documents, and each
    group is packed by one task in ``packing_order``.  The number of groups
    follows the number of pieces, so a task's work is fixed.
    """
    total = cuts.count()
    groups = max(1, -(-total // group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows["length"].to_numpy()
        order = packing_order(lengths, capacity)
        bins, offsets = sum_of_squares(lengths[order], capacity)
        sequence, offset = np.empty_like(bins), np.empty_like(offsets)
        sequence[order] = bins + (TaskContext.get().partitionId() << 32)
        offset[order] = offsets
        rows = rows.append_column("sequence_id", pa.array(sequence))
        yield from rows.append_column("offset", pa.array(offset)).to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    dealt = cuts.repartition(groups)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row for each piece of each document of ``df``, with its place.

    Null texts are empty: their one piece holds the end id alone.  Repeated
    rows are packed each for itself, other columns are ignored, an empty table
    gives no rows.  A text of any length is encoded whole in one task, some
    ten bytes of memory for each of its own, and then cut.
    """
    return pack(materialized(pieces(df, capacity, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from packed pieces with ids.

    A sequence has at most ``capacity`` one-id pieces, which bounds a group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        )
    )
