"""Operator 12: alignment of two tokenizers over the bytes of every document.

A slice of documents is one run of bytes.  The ends of both tokenizers' tokens
are marked in it once (one bincount); where both end, a group ends, and
between two marked ends exactly one token of each side holds the bytes, which
is one link.  Running sums over the slice, taken at the documents' bounds, give
what belongs to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import map_batches, materialized, picked, slices, text_bytes
from postpulse.llm.tokens import byte_table, check_ranks, default_tokenizer, ranked_encoder

#: Bytes of text that numpy takes at a time, one longer text at least.
SLICE_BYTES = 500_000
#: Pairs looked up in the workers; the others meet their counts in a join.
FREQUENT = 1 << 18


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_table(model) -> list[bytes]:
    """The bytes that each piece of a sentencepiece model stands for."""
    found = []
    for k in range(model.vocab_size()):
        piece = model.id_to_piece(k)
        byte = model.is_byte(k)
        found.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
    return found


class Aligner:
    """Both tokenizers and, for each id, its bytes and the text of its number."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor

        self._a = ranked_encoder(byte_level)
        self._b = SentencePieceProcessor(model_file=pieces)
        self.a_bytes, self.b_bytes = byte_table(byte_level), piece_table(self._b)
        self.a_lengths, self.b_lengths = (
            np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes)
        )

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where a side's bytes are not the text's."""
        none = np.zeros(0, dtype=np.uint32)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        found = []
        for text, b in zip(texts, self._b.encode([t or "" for t in texts], num_threads=1), strict=True):
            if not text:
                found.append((none, none))
                continue
            a, asked = self._a.encode_ordinary(f" {text}"), f" {text}".encode()
            same = b"".join(map(a_bytes.__getitem__, a)) == asked
            if same and b"".join(map(b_bytes.__getitem__, b)) == asked:
                found.append((np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)))
            else:
                found.append((none, none))
        return found


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


@dataclass
class Alignment:
    """Tokens of a slice of documents in one run of bytes.

    ``group`` arrays number each token's group; ``left`` and ``right`` are the
    tokens of each link; the bounds of documents are (documents + 1) offsets.
    """

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    left: np.ndarray
    right: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    group_bounds: np.ndarray
    link_bounds: np.ndarray


def bounds(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])


def align(
    a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray,
    a_sizes: np.ndarray, b_sizes: np.ndarray,
) -> Alignment:
    """Ids of all documents of a slice behind each other; both sides hold the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    total = int(a_ends[-1]) if len(a_ends) else 0
    marks = np.bincount(np.concatenate([a_ends, b_ends]), minlength=total + 1)
    ends, cuts = np.flatnonzero(marks), np.flatnonzero(marks == 2)
    a_bounds, b_bounds = bounds(a_sizes), bounds(b_sizes)
    starts = np.concatenate([[0], a_ends])[a_bounds]
    return Alignment(
        a,
        b,
        np.searchsorted(cuts, a_ends),
        np.searchsorted(cuts, b_ends),
        np.searchsorted(a_ends, ends),
        np.searchsorted(b_ends, ends),
        a_bounds,
        b_bounds,
        np.searchsorted(cuts, starts, side="right"),
        np.searchsorted(ends, starts, side="right"),
    )


def segment_sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sums between bounds, from one running sum (exact modulo 2 ** 64)."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[limits]
    return running[1:] - running[:-1]


@dataclass(frozen=True)
class Numbers:
    """Every id as text: of A before ``,`` and ``|``, of B before ``,``, ``;`` and nothing."""

    a_size: int
    b_size: int
    texts: list[str]

    @staticmethod
    def of(a_size: int, b_size: int) -> Numbers:
        sides = ((a_size, (",", "|")), (b_size, (",", ";", "")))
        return Numbers(a_size, b_size, [f"{k}{end}" for size, ends in sides for end in ends for k in range(size)])


def groups_texts(found: Alignment, numbers: Numbers) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids of both sides, group by group."""
    n_groups = int(found.group_bounds[-1])
    b_before = bounds(np.bincount(found.group_b, minlength=n_groups))
    a_before = bounds(np.bincount(found.group_a, minlength=n_groups))
    a_codes, b_codes = found.a.copy(), found.b + 2 * numbers.a_size
    a_codes[a_before[1:] - 1] += numbers.a_size
    b_codes[b_before[1:] - 1] += numbers.b_size
    b_codes[found.b_bounds[1:][found.b_bounds[1:] > found.b_bounds[:-1]] - 1] += numbers.b_size
    codes = np.empty(len(a_codes) + len(b_codes), dtype=np.int64)
    codes[np.arange(len(a_codes)) + b_before[found.group_a]] = a_codes
    codes[np.arange(len(b_codes)) + a_before[found.group_b + 1]] = b_codes
    limits = (found.a_bounds + found.b_bounds).tolist()
    every = list(map(numbers.texts.__getitem__, codes.tolist()))
    return ["".join(every[s:e]) for s, e in zip(limits, limits[1:], strict=False)]


def ids_column(ids: list[np.ndarray], dtype: str) -> pa.Array:
    return pa.array([x.astype(dtype).tobytes() for x in ids], type=pa.binary())


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level tokenizer (A) and a sentencepiece model (B)."""

    byte_level: str
    pieces: str

    @staticmethod
    def default() -> Tokenizers:
        return Tokenizers(default_tokenizer(), default_pieces())

    def loaded(self) -> Aligner:
        return aligner(self.byte_level, self.pieces)


def tokenized(df: DataFrame, tokenizers: Tokenizers, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a_ids and b_ids, written down once.

    Ids are kept in two bytes each where the vocabulary allows it.
    """
    rows = picked(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers.loaded()
        numbers = Numbers.of(len(both.a_bytes), len(both.b_bytes))
        for batch in batches:
            for start, end in slices(text_bytes(batch), SLICE_BYTES):
                part = batch.slice(start, end - start)
                ids = both.encode(part.column(1).to_pylist())
                a, b = ([x[k] for x in ids] for k in (0, 1))
                found = _aligned(both, a, b)
                digests = [
                    hashlib.sha256(x.encode()).hexdigest() if x else ""
                    for x in groups_texts(found, numbers)
                ]
                limits = (found.a_bounds, found.b_bounds, found.group_bounds, found.link_bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(np.diff(x), type=pa.int64()) for x in limits],
                        pa.array(digests, type=pa.string()),
                        ids_column(a, id_type(len(both.a_bytes))),
                        ids_column(b, id_type(len(both.b_bytes))),
                    ],
                    names=["doc_id", *counts, "groups_sha256", "a_ids", "b_ids"],
                )

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string"
    found = rows.mapInArrow(run, f"{schema}, a_ids binary, b_ids binary")
    return materialized(found.withColumn("row", F.monotonically_increasing_id()), "tokenized", compression="zstd")


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _aligned(both: Aligner, a: list[np.ndarray], b: list[np.ndarray]) -> Alignment:
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (a, b)]
    empty = np.zeros(0, dtype=np.int64)
    flat = [np.concatenate([empty, *side]).astype(np.int64) for side in (a, b)]
    return align(*flat, both.a_lengths, both.b_lengths, *sizes)


def stored_slices(both: Aligner, batch: pa.RecordBatch, a: int, b: int) -> Iterator[tuple[int, int, Alignment]]:
    """Alignments of stored ids (columns ``a`` and ``b``), slice by slice."""
    sides = [
        [np.frombuffer(x, dtype=id_type(len(table))) for x in batch.column(k).to_pylist()]
        for k, table in ((a, both.a_bytes), (b, both.b_bytes))
    ]
    sizes = np.array([int(both.a_lengths[x].sum()) for x in sides[0]], dtype=np.int64)
    for start, end in slices(sizes, SLICE_BYTES):
        yield start, end, _aligned(both, sides[0][start:end], sides[1][start:end])


def pair_counts(tokens: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """pair (A's id times B's vocabulary, plus B's id) and n, its links in the whole corpus.

    Links are counted slice by slice before they are shuffled.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = tokenizers.loaded()
        width = len(both.b_bytes)
        seen = [
            np.unique(x.a[x.left] * width + x.b[x.right], return_counts=True)
            for _, _, x in stored_slices(both, batch, 0, 1)
        ]
        pairs, counts = (np.concatenate([x[k] for x in seen]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    links = map_batches(tokens.select("a_ids", "b_ids"), work, "pair long, n long")
    return materialized(links.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


@dataclass(frozen=True)
class Frequent:
    """Sorted pairs with at least ``least`` links, their counts, and each B id's highest count."""

    pairs: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    least: int

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of ``pairs``; 0 for those that are not held."""
        if not len(self.pairs):
            return np.zeros(len(pairs), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.counts[at], 0)


def frequent_pairs(counts: DataFrame, highest: DataFrame, width: int, most: int) -> Frequent:
    """The pairs with at least (all links / ``most``) links: no more than ``most`` pairs, whatever the corpus.

    ``highest`` has one row for each id of B that occurs: B's vocabulary bounds it.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(1, -(-total // most))
    kept, best = counts.where(F.col("n") >= least).toArrow(), highest.toArrow()
    pairs, numbers = (np.asarray(kept[c], dtype=np.int64) for c in ("pair", "n"))
    order = np.argsort(pairs)
    table = np.zeros(width, dtype=np.int64)
    table[np.asarray(best["b"], dtype=np.int64)] = np.asarray(best["highest"], dtype=np.int64)
    return Frequent(pairs[order], numbers[order], table, least)


#: Columns of the report that ``tokenized`` has already.
KEPT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def looked_up(tokens: DataFrame, tokenizers: Tokenizers, known: Frequent) -> DataFrame:
    """``tokens`` with n_best and count_sum over its links that ``known`` holds, and the others.

    ``rare`` lists (pair, n): the row's other pairs and their links in it.
    """
    held = tokens.sparkSession.sparkContext.broadcast(known)
    names = ("row", *KEPT)
    rare_type = pa.struct([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, known = tokenizers.loaded(), held.value
        width, size = len(both.b_bytes), len(both.a_bytes) * len(both.b_bytes)
        for batch in batches:
            for start, end, x in stored_slices(both, batch, len(names), len(names) + 1):
                right = x.b[x.right]
                pairs = x.a[x.left] * width + right
                counts = known.of(pairs)
                best = (counts > 0) & (counts == known.best[right])
                unknown = np.flatnonzero(counts == 0)
                owners = np.repeat(np.arange(end - start), np.diff(x.link_bounds))[unknown]
                keys, n = np.unique(owners * size + pairs[unknown], return_counts=True)
                limits = np.searchsorted(keys, np.arange(end - start + 1) * size)
                rare = pa.StructArray.from_arrays(
                    [pa.array(keys % size), pa.array(n)], fields=list(rare_type)
                )
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k) for k in range(len(names))],
                        pa.array(segment_sums(best, x.link_bounds)),
                        pa.array(segment_sums(counts, x.link_bounds)),
                        pa.ListArray.from_arrays(pa.array(limits, type=pa.int32()), rare),
                    ],
                    names=[*names, "n_best", "count_sum", "rare"],
                )

    rows = tokens.select(*names, "a_ids", "b_ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[: len(names)])
    more = "n_best long, count_sum long, rare array<struct<pair: long, n: long>>"
    return materialized(rows.mapInArrow(run, f"{fields}, {more}"), "looked_up", compression="zstd")


def alignment_report(
    df: DataFrame,
    tokenizers: Tokenizers | None = None,
    frequent: int = FREQUENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    Each token of A is linked with the tokens of B that share a byte with it.
    ``count_sum`` adds up, over a row's links, how many links of the corpus
    hold the same two ids; ``n_best`` counts the links whose number is the
    highest of their B id, ties included.

    Null and empty texts, and those whose bytes a tokenizer changes, have no
    tokens: zeros and an empty digest.  Repeated rows and null ids are rows of
    their own and count each; other columns are ignored; an empty table gives
    no rows.  A text is taken whole, some 40 bytes of memory for each of its own.

    Pairs with many links are looked up where the documents are, in a table
    of at most ``frequent`` entries; every other pair has less than 1 in
    ``frequent`` of the corpus's links and meets its count in a join, which
    therefore has no hot key.
    """
    tokenizers = tokenizers or Tokenizers.default()
    check_ranks(tokenizers.byte_level)
    width = len(tokenizers.loaded().b_bytes)
    tokens = tokenized(df, tokenizers, id_col, text_col)
    counts = pair_counts(tokens, tokenizers)
    by_b = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("highest"))
    highest = materialized(by_b, "highest")
    known = frequent_pairs(counts, highest, width, frequent)
    found = looked_up(tokens, tokenizers, known)

    rare_counts = (
        counts.where(F.col("n") < known.least)
        .withColumn("b", F.col("pair") % width)
        # One row for each id of B's vocabulary.
        .join(F.broadcast(highest), "b")
        .select("pair", F.col("n").alias("links"), (F.col("n") == F.col("highest")).alias("is_best"))
    )
    sums = (
        found.select("row", F.explode("rare").alias("r"))
        .select("row", "r.pair", "r.n")
        .join(rare_counts, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.col("links")).alias("rare_sum"),
            F.sum(F.when(F.col("is_best"), F.col("n"))).alias("rare_best"),
        )
    )
    more = {"n_best": "rare_best", "count_sum": "rare_sum"}
    whole = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in more.items()]
    return found.drop("rare").join(sums, "row", "left").select(
        *KEPT[:5], *whole, "groups_sha256"
    )
