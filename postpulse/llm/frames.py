"""Operator 9: token ids in seekable zstandard files.

A file is a run of independent zstandard frames followed by a seek table:

* data frames: the documents' ids, little-endian unsigned 32-bit, whole
  documents, in ascending id order; one document to a frame unless asked
  otherwise, so that a reader decompresses only what it wants;
* seams: skippable frames of one byte, where a chunk of the file ended;
* one index frame: for each document its id, data frame, first id within that
  frame and number of ids (four little-endian 64-bit integers);
* a skippable frame with the seek table of the public "zstd seekable format":
  for each frame its compressed size, its size and the low 32 bits of the
  XXH64 of its content, then the number of frames and the format's magic.

A reader takes the table from the end of the file, then the index, then only
the frames that hold what was asked for, by ranged reads.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm.common import fresh_path, picked
from postpulse.llm.tokens import END_ID, ID_BYTES, default_tokenizer, encoder

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")
_HEADER = struct.Struct("<II")
_INDEX = np.dtype([("doc", "<i8"), ("frame", "<i8"), ("first", "<i8"), ("count", "<i8")])

#: A frame closes once it holds this many ids.  With 1 each document has a frame
#: of its own; more compress better and make readers decompress neighbours.
FRAME_IDS = 1
#: Bytes of frames that leave the builder at a time, which is what a task holds
#: (and its index and seek table).
CHUNK_BYTES = 1 << 20
#: Input bytes for a file, where that asks for more files than there are shuffle partitions.
FILE_BYTES = 256 << 20
#: The last byte of the format's magic; chunks end in it, as the file does.
LAST = SEEKABLE_MAGIC >> 24
_SEAM = _HEADER.pack(0x184D2A50, 1) + bytes([LAST])


class FileBuilder:
    """Builds one file from documents added in order; chunks leave as they are full."""

    def __init__(self, frame_ids: int = FRAME_IDS, level: int = 3):
        self._frame_ids = frame_ids
        self._packer = zstandard.ZstdCompressor(level=level)
        self._frames: list[bytes] = []
        self._table: list[bytes] = []
        self._index: list[tuple[int, int, int, int]] = []
        self._open: list[bytes] = []
        self._held = 0
        self.waiting = 0
        self.n_documents = 0

    def add(self, doc: int, ids: bytes) -> None:
        count = len(ids) // ID_BYTES
        self._index.append((doc, len(self._table), self._held, count))
        self._open.append(ids)
        self._held += count
        self.n_documents += 1
        if self._held >= self._frame_ids:
            self._close_frame()

    def _entry(self, packed: bytes, content: bytes) -> None:
        check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        self._table.append(_ENTRY.pack(len(packed), len(content), check))
        self._frames.append(packed)
        self.waiting += len(packed)

    def _frame(self, content: bytes) -> None:
        self._entry(self._packer.compress(content), content)

    def _close_frame(self) -> None:
        self._frame(b"".join(self._open))
        self._open, self._held = [], 0

    def _taken(self) -> bytes:
        out, self._frames, self.waiting = b"".join(self._frames), [], 0
        return out

    def chunk(self) -> bytes:
        """All frames so far, the open one closed, and a seam."""
        if self._open:
            self._close_frame()
        self._entry(_SEAM, b"")
        return self._taken()

    def finish(self) -> bytes:
        """The rest of the file: open documents, index and seek table."""
        if self._open:
            self._close_frame()
        self._frame(np.array(self._index, dtype=_INDEX).tobytes())
        footer = _FOOTER.pack(len(self._table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        table = b"".join(self._table) + footer
        return b"".join([self._taken(), _HEADER.pack(SKIPPABLE_MAGIC, len(table)), table])


class FileReader:
    """Reads documents of one file; ``source`` is its bytes or a seekable binary file."""

    def __init__(self, source):
        self._bytes = source if isinstance(source, bytes | memoryview) else None
        self._file = source
        self._ahead, self._ahead_at = b"", 0
        self._unpacker = zstandard.ZstdDecompressor()
        size = len(source) if self._bytes is not None else source.seek(0, 2)
        n, flags, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        at = size - _FOOTER.size - n * _ENTRY.size
        entries = np.frombuffer(self._read(at, n * _ENTRY.size), dtype="<u4").reshape(n, 3)
        self._entries = entries.tolist()
        self._at = [0, *np.cumsum(entries[:, 0], dtype=np.int64).tolist()]
        self.index = np.frombuffer(self.frame(n - 1), dtype=_INDEX)

    @property
    def n_ids(self) -> int:
        return int(self.index["count"].sum())

    def _read(self, at: int, size: int, ahead: int = 0) -> bytes:
        """``size`` bytes from ``at``; with ``ahead`` at least so many are fetched and kept."""
        if self._bytes is not None:
            return bytes(self._bytes[at : at + size])
        if not ahead:
            self._file.seek(at)
            return self._file.read(size)
        start = at - self._ahead_at
        if start < 0 or start + size > len(self._ahead):
            self._file.seek(at)
            self._ahead, self._ahead_at, start = self._file.read(max(size, ahead)), at, 0
        return self._ahead[start : start + size]

    def frame(self, k: int, ahead: int = 0) -> bytes:
        """Frame ``k``, decompressed; its checksum must hold."""
        packed, size, check = self._entries[k]
        content = self._unpacker.decompress(
            self._read(self._at[k], packed, ahead), max_output_size=max(size, 1)
        )
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(doc, ids) in file order, of all documents or of those ``wanted``."""
        rows, ahead = self.index, CHUNK_BYTES
        if wanted is not None:
            rows, ahead = rows[np.isin(rows["doc"], np.fromiter(wanted, dtype=np.int64))], 0
        held, content = -1, b""
        for low in range(0, len(rows), 10_000):
            for doc, frame, first, count in rows[low : low + 10_000].tolist():
                if frame != held:
                    held, content = frame, self.frame(frame, ahead)
                yield doc, content[first * ID_BYTES : (first + count) * ID_BYTES]


#: Spark's estimates above this mostly stand for an unknown size, so they are checked by counting.
UNKNOWN_BYTES = 1 << 50


def _file_count(df: DataFrame, file_bytes: int) -> int | None:
    """Files that the input's size asks for, where shuffle partitions are fewer.

    ``df`` has the columns doc_id and text.  An input whose size Spark does not
    know (or puts above ``UNKNOWN_BYTES``) is counted once.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        own = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
        size = int(df.agg(F.sum(own.cast("long"))).first()[0] or 0)
    wanted = -(-size // file_bytes)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted if usual < wanted else None


def write_ids(
    df: DataFrame,
    path: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
    frame_ids: int = FRAME_IDS,
) -> None:
    """Encode every text, end it with ``END_ID``, and write seekable files below ``path``.

    Documents are range-partitioned and sorted by id (null ids first, kept as
    the smallest 64-bit integer), so the order of files and in files is that
    of ids.  Rows that share an id come in the order of their texts' hashes;
    ranges may part them, and even equal rows, so that no id is one task's
    burden.  Null texts are empty, and an empty table gives no documents.  A text
    of any length is encoded whole and is one frame.

    Each task streams one file.  It goes through Spark's text writer, whose
    commit protocol makes retried tasks harmless on any store: a row is a
    chunk of the file, and the line separator the byte that every chunk ends in.
    """
    vocabulary = tokenizer or default_tokenizer()
    rows = picked(df, doc_id=id_col, text=text_col)
    files = _file_count(rows, file_bytes)
    rows = rows.withColumns(
        {
            "doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
            "text": F.coalesce("text", F.lit("")),
        }
    ).withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    places = ("doc_id", "mark", "row")
    rows = rows.repartitionByRange(*([files] if files else []), *places)
    rows = rows.sortWithinPartitions(*places).select("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end, builder = END_ID.to_bytes(ID_BYTES, "little"), FileBuilder(frame_ids)

        def row(chunk: bytes) -> pa.RecordBatch:
            # The writer adds the last byte.
            return pa.RecordBatch.from_arrays(
                [pa.array([memoryview(chunk)[:-1]], type=pa.binary())], names=["content"]
            )

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                builder.add(doc, encode(text) + end)
                if builder.waiting >= CHUNK_BYTES:
                    yield row(builder.chunk())
        if builder.n_documents:
            yield row(builder.finish())

    (
        rows.mapInArrow(build, "content binary")
        .select(F.col("content").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", chr(LAST))
        .option("compression", "none")
        .option("maxRecordsPerFile", 0)
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file and path of each file; ``file`` is its place in the order.  No content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long")
    return found.where("length > 0").select(number.alias("file"), "path")


def opened(path: str):
    """A file of the shared folder for ranged reads: a local one, or of a store pyarrow knows."""
    from pyarrow import fs

    local = re.sub(r"^file:/*(?=/)", "", path)
    if ":/" not in local:
        return fs.LocalFileSystem().open_input_file(local)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _documents(
    files: DataFrame, wanted: list[int] | None, columns: str, cells, most: int = 1 << 23
) -> DataFrame:
    """file and ``cells(doc, ids before it in the file, ids)`` of each document, batch by batch."""
    names = ["file", *[c.split()[0] for c in columns.split(", ")]]
    schema = f"file long, {columns}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] + [
            pa.binary() if c.endswith("binary") else pa.int64() for c in columns.split(", ")
        ]

        def made(out: list[tuple]) -> pa.RecordBatch:
            arrays = zip(zip(*out, strict=True), kinds, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in arrays], names=names)

        for batch in batches:
            for number, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, held, before = [], 0, 0
                with opened(path) as source:
                    for doc, ids in FileReader(source).documents(wanted):
                        out.append((number, *cells(doc, before, ids)))
                        before += len(ids) // ID_BYTES
                        held += 64 + len(ids)
                        if held >= most:
                            yield made(out)
                            out, held = [], 0
                if out:
                    yield made(out)

    return files.mapInArrow(work, schema)


def read_ids(
    spark: SparkSession, path: str, wanted: Iterable[int] | None = None
) -> DataFrame:
    """file, doc_id and ids (binary) of all or the wanted documents.

    Files are read where their tasks run; only frames with wanted documents
    are fetched and decompressed.
    """
    chosen = None if wanted is None else sorted(set(wanted))
    cells = lambda doc, before, ids: (doc, ids)
    return _documents(_files(spark, path), chosen, "doc_id long, ids binary", cells)


def ids_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    A first pass reads only seek tables and indexes for the ids of each file;
    their running sum gives each file's start.  It has one row for each file,
    some four in a gigabyte.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path_ in batch.column(1).to_pylist():
                with opened(path_) as source:
                    sums.append(FileReader(source).n_ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, type=pa.int64())], names=["file", "n_ids"]
            )

    files = _files(spark, path)
    sizes = files.mapInArrow(totals, "file long, n_ids long")
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        F.col("file").alias("of"), F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first")
    )
    cells = lambda doc, before, ids: (doc, before, len(ids) // ID_BYTES, zlib.crc32(ids))
    fields = "doc_id long, before long, n_tokens long, ids_crc32 long"
    none = F.lit(-(1 << 63))
    rows = _documents(files, None, fields, cells)
    return rows.join(firsts, F.col("file") == F.col("of")).select(
        F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"),
        (F.col("first") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def encode_and_report(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to fresh files in the shared folder and report from them."""
    spark = df.sparkSession
    path = fresh_path(spark, "ids")
    write_ids(df, path, **options)
    return ids_report(spark, path)
