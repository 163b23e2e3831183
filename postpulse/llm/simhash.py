"""Operator 5: SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``d`` bits differ in at most
``d`` of their eight bytes, so they share at least ``8 - d`` byte positions.
That guaranteed minimum is used twice.

* Retrieval.  Any two that share ``8 - d`` of 8 positions share at least ``d +
  1 = 4`` of the first seven (for d = 3).  Postings are therefore keyed by
  four of those positions with their bytes, 35 keys each; both fingerprints
  of a near pair meet under every key that they share.
* Count filtering.  Under a key, the shared positional bytes of each pair are
  tallied; pairs below the minimum are dropped and the rest verified bit by
  bit.  A pair counts only under the first key that it shares.

Keys with many fingerprints are split into blocks that are compared with
themselves and with each other in tasks of their own, and a tile of
comparisons reports edges that connect what it found linked, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from postpulse.llm.common import map_batches, materialized, picked, unused_name
from postpulse.llm.graph import components, joined_up

MAX_BITS = 3
SHINGLE_WORDS = 3
SEED = 42
POSITIONS = 8
#: Fingerprints of a block: what a task compares with itself and others at a time.
BLOCK_ROWS = 4096
SALT_BITS = 25
#: Rows of a tile of comparisons.
TILE = 512


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority of the shingles' XXH64 bits; a bit set in exactly half is 0.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at ASCII white
    space only, as the definition asks.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined, digest = b" ".join, xxhash.xxh64_intdigest
    shifted = zip(*[islice(tokens, k, None) for k in range(words)], strict=False)
    bits = np.zeros(64, dtype=np.int64)
    while block := [digest(joined(s), SEED) for s in islice(shifted, 1 << 16)]:
        octets = np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(tokens) - words + 1).view(">u8")[0])


def fingerprints(
    df: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a bigint); null texts are empty, fp 0."""
    rows = picked(df, doc_id=id_col, text=text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", words) for t in texts], dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, fp long")


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(0xFF))


def _postings(prints: DataFrame, max_bits: int) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """key, fp: each fingerprint under every choice of indexed positions."""
    together = max_bits + 1
    prefix = POSITIONS - (POSITIONS - max_bits) + together
    choices = list(combinations(range(prefix), together))
    keys = []
    for number, chosen in enumerate(choices):
        key = F.lit(number).cast("long")
        for position in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp"), choices


def _first_choice(pairs: np.ndarray, together: int) -> np.ndarray:
    """Of each pair, its first ``together`` shared positions as a bit mask."""
    octets = (pairs[:, 0] ^ pairs[:, 1]).astype("<u8").view(np.uint8).reshape(-1, POSITIONS)
    shared = octets == 0
    first = shared & (np.cumsum(shared, axis=1) <= together)
    return np.packbits(first, axis=1, bitorder="little")[:, 0]


def _blocks(postings: DataFrame, block_rows: int) -> DataFrame:
    """key, probe, fp: keys with their block, each row in its own block and before all later ones.

    A key with up to ``block_rows`` fingerprints is one block.  In a fuller
    one a row is a member of one block, by its hash, and looked up in those
    after it, so that any two rows meet once.
    """
    crowded = postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    crowded = crowded.select(
        F.col("key").alias("of"), F.ceil(F.col("n") / block_rows).alias("blocks")
    )
    rows = postings.join(crowded, F.col("key") == F.col("of"), "left")
    last = F.coalesce("blocks", F.lit(1)) - 1
    rows = rows.select("key", "fp", F.pmod(F.xxhash64("fp"), last + 1).alias("own"), last.alias("last"))
    rows = rows.select("key", "fp", "own", F.explode(F.sequence("own", "last")).alias("block"))
    key = F.shiftleft("key", SALT_BITS).bitwiseOR(F.col("block"))
    return rows.select(key.alias("key"), (F.col("block") != F.col("own")).alias("probe"), "fp")


def _tile(
    own: np.ndarray, others: np.ndarray, chosen: tuple[int, ...], max_bits: int
) -> Iterator[np.ndarray]:
    """Edges (two columns) that connect the near pairs of ``own`` and ``others``.

    All share the ``chosen`` bytes; pairs that share an earlier choice count there.
    """
    octets = own.astype("<u8").view(np.uint8).reshape(-1, POSITIONS)
    against = np.ascontiguousarray(others.astype("<u8").view(np.uint8).reshape(-1, POSITIONS).T)
    mask = sum(1 << p for p in chosen)
    for low in range(0, len(own), TILE):
        part = own[low : low + TILE]
        tally = np.zeros((len(part), len(others)), dtype=np.uint8)
        for position in range(POSITIONS):
            tally += octets[low : low + TILE, position, None] == against[position]
        left, right = np.nonzero(tally >= POSITIONS - max_bits)
        pair = np.column_stack([part[left], others[right]])
        bits = np.bitwise_count(pair[:, 0] ^ pair[:, 1])
        close = (bits > 0) & (bits <= max_bits)
        close[close] = _first_choice(pair[close], len(chosen)) == mask
        if close.any():
            rows, at = np.unique(left[close], return_inverse=True)
            columns, to = np.unique(right[close], return_inverse=True)
            linked = np.zeros((len(rows), len(columns)), dtype=bool)
            linked[at, to] = True
            yield joined_up(linked, part[rows].view(np.int64), others[columns].view(np.int64))


def edges(
    prints: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """a, b: edges that connect exactly what links of 1 to ``max_bits`` bits connect.

    ``prints`` holds distinct fingerprints in column ``fp``.  Every pair within
    ``max_bits`` is found; of a tile's pairs a spanning forest is reported, so
    a dense group costs rows in proportion to its size.
    """
    postings, choices = _postings(prints, max_bits)
    together = max_bits + 1
    if comb(together + max_bits, together) != len(choices) or together + max_bits > POSITIONS:
        raise ValueError(f"{max_bits} bits leave no shared bytes to index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block, members before lookups; a block may go on in the next batch.
        nothing = np.zeros(0, np.int64)
        keys, probe, fps = nothing, nothing.astype(bool), nothing.astype(np.uint64)

        def choice(key: int) -> tuple[int, ...]:
            return choices[key >> (8 * together + SALT_BITS)]

        def groups(end: int) -> Iterator[np.ndarray]:
            bounds = np.flatnonzero(np.diff(keys[:end], prepend=-1, append=-1))
            for n in np.flatnonzero(np.diff(bounds) > 1).tolist():
                low, high = int(bounds[n]), int(bounds[n + 1])
                side, group = probe[low:high], fps[low:high]
                members, chosen = group[~side], choice(int(keys[low]))
                yield from _tile(members, members, chosen, max_bits)
                if side.any():
                    yield from _tile(members, group[side], chosen, max_bits)

        def report(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if found:
                both = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            keys, probe = np.concatenate([keys, new[0]]), np.concatenate([probe, new[1]])
            fps = np.concatenate([fps, new[2].view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1]))
            found = list(groups(cut))
            keys, probe, fps = keys[cut:], probe[cut:], fps[cut:]
            if probe.any():  # all members are here: the lookups so far are done with
                found += _tile(fps[~probe], fps[probe], choice(int(keys[0])), max_bits)
                keys, fps, probe = keys[~probe], fps[~probe], probe[~probe]
            yield from report(found)
        yield from report(list(groups(len(keys))))

    blocks = _blocks(postings, block_rows).repartition("key").sortWithinPartitions("key", "probe")
    return blocks.mapInArrow(run, "a long, b long")


def _classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, first (its smallest id) and component of every distinct fp of ``prints`` (doc_id, fp)."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = materialized(classes, "classes")
    linked = components(edges(classes.select("fp"), max_bits))
    return classes.join(linked, classes["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(
    df: DataFrame,
    max_bits: int = MAX_BITS,
    words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fp and component_id of every row of ``df``.

    component_id is the smallest id reachable over links, the row's own
    included; repeated rows and ids share it.  Null ids stay null and lend
    their component no name (null if it has no other).  Null and empty texts
    have fingerprint 0; an empty table gives no rows; other columns are
    ignored.  Copies collapse to one fingerprint before any comparison; texts
    themselves are never shuffled.
    """
    docs = materialized(fingerprints(df, words, id_col, text_col), "fingerprints")
    named = _classes(docs, max_bits)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    smallest = smallest.select(F.col("component").alias("of"), "component_id")
    of_class = named.join(smallest, F.col("component") == F.col("of"))
    of_class = of_class.select(F.col("fp").alias("same_fp"), "component_id")
    return docs.join(of_class, F.col("fp") == F.col("same_fp")).select(
        "doc_id", "fp", "component_id"
    )


def _with_print(df: DataFrame, text_col: str, words: int, name: str) -> DataFrame:
    """``df`` and its texts' fingerprints in column ``name``."""
    place = df.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", words) for t in texts], dtype=np.uint64)
        columns = [*batch.columns, pa.array(found.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return map_batches(df, work, StructType([*df.schema.fields, StructField(name, LongType())]))


def first_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Of each group one row, with its smallest id, and all columns of ``df``.

    Rows are chosen by id and fingerprint: where one id has texts of several
    groups, each group keeps its own row.  Among repeats of a chosen row, and
    among a group's texts under one id, the smallest fingerprint, then the
    smallest text, then the smallest other columns stay.  Rows with a null id
    belong to no group's choice and stay.  Columns may have any names.  The
    choice among repeats and the semi-join share one partitioning, and repeats
    go before they are shuffled.
    """
    name, rank, of, fp = (unused_name(df, n) for n in ("print", "rank", "chosen_id", "chosen_fp"))
    rows = materialized(
        _with_print(df.where(F.col(id_col).isNotNull()), text_col, words, name), "printed"
    )
    prints = rows.select(rows[id_col].alias("doc_id"), rows[name].alias("fp"))
    chosen = _classes(prints, max_bits).groupBy("component").agg(
        F.min(F.struct("first", "fp")).alias("least")
    )
    chosen = chosen.select(F.col("least.first").alias(of), F.col("least.fp").alias(fp))
    others = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, AtomicType) and f.name not in (id_col, text_col)
    ]
    order = Window.partitionBy(id_col, name).orderBy(text_col, *others)
    single = rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    same = (F.col(id_col) == F.col(of)) & (F.col(name) == F.col(fp))
    kept = single.join(chosen, same, "left_semi").select(*df.columns)
    return kept.union(df.where(F.col(id_col).isNull()))


def hex_digits(fp: str = "fp") -> F.Column:
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
