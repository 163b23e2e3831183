"""A crawl's index as a Spark data source, format ``crawl_index``; ``table`` reads it.

An index is a sorted text (``cluster.idx``: key and timestamp, file, offset,
length, by tabs), one line for each gzip member of its files; a member holds
some thousands of lines ``key timestamp {JSON}``.  Filters on ``key`` become a
range of the sorted text, found by a binary search that reads a few thousand
bytes; the range is cut into byte ranges, one for each task, and a task reads
its lines and then the members they name.  Neither the driver nor a task ever
lists an index.

Reading options: ``path`` (a folder, ``{crawl}`` in it stands for the crawl),
``crawls`` (comma-separated), ``index`` (name of the sorted text),
``task_bytes`` (bytes of it for each task), ``failures`` (``rows``: what cannot
be read comes back as a row with its reason in ``error``; ``raise``).  Writing
options: ``path``, ``block_lines`` (lines of a gzip member).  Rows to write are
sorted by key within each partition.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from postpulse.sources import stores

FIELDS = ("url", "status", "mime", "filename", "offset", "length")
SCHEMA = "crawl string, key string, timestamp string, {}, error string".format(
    ", ".join(f"{f} string" for f in FIELDS)
)
#: Names of the parts that a written index consists of, with their first and last keys.
PARTS = "parts.txt"
#: Bytes that a step of the binary search reads.
PROBE = 1 << 10
#: The most tasks that one index is cut into.
MOST_TASKS = 20_000


@dataclass
class Wanted:
    """Keys that filters ask for: bounds for the search, and the filters themselves."""

    low: str = ""
    high: str | None = None
    tests: list[Callable[[str], bool]] = field(default_factory=list)

    def narrow(self, low: str | None, high: str | None) -> None:
        self.low = max(self.low, low or "")
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def holds(self, key: str) -> bool:
        return all(test(key) for test in self.tests)


def after_prefix(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None if there is none."""
    for k in range(len(prefix) - 1, -1, -1):
        if prefix[k] != chr(0x10FFFF):
            following = ord(prefix[k]) + 1
            return prefix[:k] + chr(0xE000 if 0xD800 <= following <= 0xDFFF else following)
    return None


def closed(key: str) -> str:
    """Above every index line of ``key``: those go on with a space and a timestamp."""
    return f"{key}!"


def taken(wanted: Wanted, pushed: ds.Filter) -> bool:
    """Whether ``pushed`` is a filter on keys; ``wanted`` then holds it."""
    if getattr(pushed, "attribute", None) != ("key",):
        return False
    if isinstance(pushed, ds.IsNotNull):
        return True
    value = pushed.value
    match pushed:
        case ds.StringStartsWith():
            wanted.narrow(value, after_prefix(value))
            wanted.tests.append(_Starts(value))
        case ds.EqualTo():
            wanted.narrow(value, closed(value))
            wanted.tests.append(_Among((value,)))
        case ds.In():
            values = tuple(v for v in value if v is not None)
            wanted.narrow(min(values, default=""), closed(max(values, default="")))
            wanted.tests.append(_Among(values))
        case ds.GreaterThan() | ds.GreaterThanOrEqual():
            wanted.narrow(value, None)
            wanted.tests.append(_Above(value, isinstance(pushed, ds.GreaterThanOrEqual)))
        case ds.LessThan() | ds.LessThanOrEqual():
            wanted.narrow(None, closed(value))
            wanted.tests.append(_Below(value, isinstance(pushed, ds.LessThanOrEqual)))
        case _:
            return False
    return True


@dataclass(frozen=True)
class _Starts:
    prefix: str

    def __call__(self, key: str) -> bool:
        return key.startswith(self.prefix)


@dataclass(frozen=True)
class _Among:
    values: tuple[str, ...]

    def __call__(self, key: str) -> bool:
        return key in self.values


@dataclass(frozen=True)
class _Above:
    bound: str
    itself: bool

    def __call__(self, key: str) -> bool:
        return key > self.bound or self.itself and key == self.bound


@dataclass(frozen=True)
class _Below:
    bound: str
    itself: bool

    def __call__(self, key: str) -> bool:
        return key < self.bound or self.itself and key == self.bound


class SortedText:
    """Searches a text of sorted lines by byte ranges."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, probe: int = PROBE):
        self.read, self.size, self.probe = read, size, probe

    def line_after(self, at: int, limit: int) -> tuple[int, bytes] | None:
        """Place and content of the first line that starts behind ``at`` and before ``limit``."""
        held, end = b"", at
        start = -1
        while end < self.size:
            held += self.read(end, min(self.size, end + self.probe))
            end = min(self.size, end + self.probe)
            if start < 0:
                start = held.find(b"\n") + 1 or -1
                if start >= 0 and at + start >= limit or start < 0 and end >= limit:
                    return None
            if start >= 0 and ((stop := held.find(b"\n", start)) >= 0 or end >= self.size):
                line = held[start:] if stop < 0 else held[start:stop]
                return (at + start, line) if line else None
        return None

    def place(self, wanted: bytes, low: int = 0) -> tuple[int, int]:
        """Places of the last line below ``wanted`` and of the first that is not (else ``low``, the size)."""
        search, high = self.size, self.size
        while search - low > self.probe:
            middle = (low + search) // 2
            found = self.line_after(middle, high)
            if found is None:
                search = middle
            elif found[1] < wanted:
                low = found[0]
            else:
                search, high = middle, found[0]
        before, at = low, low
        for line in self.read(low, high).splitlines(keepends=True) if high > low else ():
            if line.rstrip(b"\n") >= wanted:
                return before, at
            before, at = at, at + len(line)
        return before, high

    def span(self, low: str, high: str | None) -> tuple[int, int]:
        """From the line before the first that may matter to the first that no longer does."""
        start = self.place(low.encode())[0] if low else 0
        return start, self.size if high is None else self.place(high.encode(), start)[1]

    def lines(self, start: int, end: int) -> Iterator[bytes]:
        """Lines that start in a byte range; the first range of a span starts at a line."""
        content = self.read(start, end)
        if not content.endswith(b"\n"):
            tail = b""
            while b"\n" not in tail and end < self.size:
                tail += self.read(end, min(self.size, end + self.probe))
                end = min(self.size, end + self.probe)
            content += tail[: tail.find(b"\n") + 1 or len(tail)]
        yield from content.split(b"\n")


@dataclass
class IndexPart(ds.InputPartition):
    """Bytes of one index, read by one task; ``first``: a line starts at ``start``."""

    crawl: str
    folder: str
    index: str
    size: int
    start: int
    end: int
    first: bool


class IndexReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.crawls = [c.strip() for c in options.get("crawls", "").split(",") if c.strip()] or [""]
        self.index = options.get("index", "cluster.idx")
        self.task_bytes = int(options.get("task_bytes", 4_096))
        self.raises = options.get("failures", "rows") == "raise"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for pushed in filters:
            of_crawl = getattr(pushed, "attribute", None) == ("crawl",)
            if of_crawl and isinstance(pushed, (ds.EqualTo, ds.In)):
                values = pushed.value if isinstance(pushed, ds.In) else [pushed.value]
                self.crawls = [c for c in self.crawls if c in values]
            elif of_crawl and isinstance(pushed, ds.IsNotNull):
                continue
            elif not taken(self.wanted, pushed):
                yield pushed

    def _indexes(self, folder: str) -> list[str]:
        """Names of the sorted texts of a folder that may hold wanted keys."""
        parts = stores.whole(stores.below(folder, PARTS))
        if parts is None:
            return [self.index]
        rows = [line.split("\t") for line in parts.decode().splitlines()]
        high = self.wanted.high
        return [n for n, first, last in rows if last >= self.wanted.low and (high is None or first < high)]

    def partitions(self) -> list[ds.InputPartition]:
        found: list[ds.InputPartition] = []
        for crawl in self.crawls:
            folder = self.folder.format(crawl=crawl)
            for name in self._indexes(folder):
                address = stores.below(folder, name)
                size = stores.size(address)
                if not size:
                    raise FileNotFoundError(f"no index at {address}")
                text = SortedText(lambda s, e, a=address: stores.read(a, s, e), size)
                start, end = text.span(self.wanted.low, self.wanted.high)
                step = max(self.task_bytes, -(-(end - start) // MOST_TASKS))
                found += [
                    IndexPart(crawl, folder, name, size, at, min(end, at + step), at == start)
                    for at in range(start, end, step)
                ]
        return found

    def read(self, partition: IndexPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        address = stores.below(partition.folder, partition.index)
        text = SortedText(lambda s, e: stores.read(address, s, e), partition.size)
        # A line belongs to the range that its first byte is in; one byte earlier shows whether it starts there.
        lines = text.lines(partition.start - (not partition.first), partition.end)
        if not partition.first:
            next(lines)
        for line in lines:
            parts = line.decode("utf-8", "replace").split("\t")
            if len(parts) < 4:
                continue
            try:
                at, length = int(parts[2]), int(parts[3])
                raw = stores.read(stores.below(partition.folder, parts[1]), at, at + length)
                rows = [r for r in records(gzip.decompress(raw)) if self.wanted.holds(r[0])]
            except (OSError, EOFError, ValueError, zlib.error) as error:
                if self.raises:
                    raise
                key = max(parts[0].split(" ")[0], self.wanted.low)
                reason = f"{parts[1]} {parts[2]} {parts[3]}: {type(error).__name__} {error}"
                rows = [(key, *[None] * (len(FIELDS) + 1), reason)]
            else:
                rows = [(*r, None) for r in rows]
            if rows:
                columns = [[partition.crawl] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.string()) for c in columns],
                    names=["crawl", "key", "timestamp", *FIELDS, "error"],
                )


def records(content: bytes) -> Iterator[tuple[str | None, ...]]:
    """(key, timestamp, fields) of the lines of a gzip member; lines without an address are passed over."""
    for line in content.decode("utf-8", "replace").split("\n"):
        head, brace, tail = line.partition("{")
        try:
            body = json.loads(brace + tail)
        except ValueError:
            continue
        if not body.get("url"):
            continue
        names = head.split()
        values = (body.get(f) for f in FIELDS)
        yield (
            names[0] if names else "",
            names[1] if len(names) > 1 else None,
            *[v if v is None else str(v) for v in values],
        )


def records_under(text: SortedText, folder: str, prefix: str) -> Iterator[list[dict[str, str | None]] | str]:
    """The records under ``prefix`` block by block, read one by one as they are asked for, or why a block could not be read."""
    start, end = text.span(prefix, after_prefix(prefix))
    for line in text.lines(start, end) if end > start else ():
        parts = line.decode("utf-8", "replace").split("\t")
        if len(parts) < 4:
            continue
        try:
            at, length = int(parts[2]), int(parts[3])
            raw = gzip.decompress(stores.read(stores.below(folder, parts[1]), at, at + length))
        except (OSError, EOFError, ValueError, zlib.error) as error:
            yield f"{parts[1]} {parts[2]} {parts[3]}: {type(error).__name__} {error}"
            continue
        names = ("key", "timestamp", *FIELDS)
        yield [dict(zip(names, r, strict=True)) for r in records(raw) if (r[0] or "").startswith(prefix)]


@dataclass
class Written(ds.WriterCommitMessage):
    """What a task has written: names of its two files, and the keys they run from and to."""

    index: str
    blocks: str
    first: str
    last: str


class IndexWriter(ds.DataSourceArrowWriter):
    """Each task writes one file of gzip members and their sorted text; a commit names the parts.

    Files of a job that fails, or of a task that is run again, are never named.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder = options["path"]
        self.block_lines = int(options.get("block_lines", 3_000))
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> ds.WriterCommitMessage:
        name = uuid.uuid4().hex
        index, blocks = f"cluster-{name}.idx", f"cdx-{name}.gz"
        entries: list[str] = []
        held: list[str] = []
        last, at = "", 0
        with stores.created(stores.below(self.folder, blocks)) as out:

            def flush() -> None:
                nonlocal at
                member = gzip.compress("".join(held).encode())
                out.write(member)
                start = " ".join(held[0].split(" ", 2)[:2])
                entries.append(f"{start}\t{blocks}\t{at}\t{len(member)}\n")
                at += len(member)
                held.clear()

            for batch in batches:
                for row in batch.to_pylist():
                    if not row["key"] or row["key"] < last:
                        raise ValueError(f"keys must be there and sorted: {row['key']!r} after {last!r}")
                    last = row["key"]
                    body = json.dumps({f: row[f] for f in FIELDS if row.get(f) is not None})
                    held.append(f"{last} {row['timestamp'] or ''} {body}\n")
                    if len(held) == self.block_lines:
                        flush()
            if held:
                flush()
        stores.write(stores.below(self.folder, index), "".join(entries).encode())
        return Written(index, blocks, entries[0].split(" ")[0] if entries else "", last)

    def commit(self, messages: list[Written | None]) -> None:
        before = stores.whole(stores.below(self.folder, PARTS)) or b""
        named = b"" if self.overwrite else before
        for m in messages:
            if m and m.last:
                named += f"{m.index}\t{m.first}\t{m.last}\n".encode()
            elif m:
                self._drop(m)
        stores.write(stores.below(self.folder, PARTS), named)

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            self._drop(m)

    def _drop(self, message: Written) -> None:
        for name in (message.index, message.blocks):
            stores.remove(stores.below(self.folder, name))


class CrawlIndex(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> IndexWriter:
        return IndexWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CrawlIndex)


def table(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """An index as a table, every plan of which pushes its own filters.

    Spark 4.1 keeps the filters that one plan of a loaded frame has pushed for
    later plans of it that push none, so that those lose rows.  The condition
    added here always is one to push.
    """
    register(spark)
    found = spark.read.format("crawl_index").option("path", path).options(**options).load()
    return found.where("key IS NOT NULL")
