"""A web crawl's index and records: sorted key lines, gzip blocks, archived payloads."""

from __future__ import annotations

import gzip
import json
import time
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def blocks_for(index: DataFrame, prefix: str) -> DataFrame:
    """Blocks of a sorted secondary index that may hold keys with ``prefix``.

    ``index`` has key (first of its block), file, offset and length, and is
    range-filtered before any ordering: of the keys below the prefix only the
    last matters, as its block runs into the range.
    """
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1)
    inside = index.where((F.col("key") >= prefix) & (F.col("key") < end))
    below = index.where(F.col("key") < prefix).orderBy(F.desc("key")).limit(1)
    return below.unionByName(inside)


def records(lines: DataFrame, prefix: str) -> DataFrame:
    """``lines`` (value: key, timestamp, JSON) under ``prefix``, parsed."""
    rows = lines.where(F.col("value").startswith(prefix))
    parts = F.split("value", " ", 3)
    body = F.from_json(parts[2], "url string, status string, mime string, filename string, offset string, length string")
    return rows.select(parts[0].alias("key"), parts[1].alias("timestamp"), body.alias("r")).select(
        "key", "timestamp", "r.*"
    )


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of index blocks; gzip is undone by the reader."""
    return spark.read.text(path)


def payload(record: Column) -> Column:
    """struct(headers, body) of an archived record: what follows the second blank line."""
    parts = F.split(record, "\r\n\r\n", 3)
    return F.struct(F.get(parts, F.lit(1)).alias("headers"), F.get(parts, F.lit(2)).alias("body"))


def harvest(urls: DataFrame, token: Column, provider: str) -> DataFrame:
    """Distinct tokens of a harvest, with how many of its pages name them."""
    rows = urls.select(F.lit(provider).alias("provider"), token.alias("token"))
    return rows.where(F.col("token").isNotNull()).groupBy("provider", "token").agg(
        F.count("*").alias("pages")
    )


def newest_captures(captures: DataFrame, wanted: int = 3, most: int = 10) -> DataFrame:
    """Per host the newest ``wanted`` captures that answered, within its newest ``most``."""
    newest = Window.partitionBy("host").orderBy(F.desc("timestamp"))
    rows = captures.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    good = rows.where(F.col("status") == "200")
    ranked = good.withColumn("n", F.row_number().over(newest))
    return ranked.where(F.col("n") <= wanted).drop("n")


def payloads(records_: DataFrame) -> DataFrame:
    """``records_`` (a binary column ``content``, gzip or plain) with headers and body.

    A gzip record is undone whole; one that does not parse has neither.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [record_parts(c) for c in frame["content"]]
            yield frame.assign(headers=[f[0] for f in found], body=[f[1] for f in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records_.schema)
    return records_.mapInPandas(run, f"{schema}, headers string, body string")


def record_parts(content: bytes | None) -> tuple[str | None, str | None]:
    """(headers, body) of one archived record: the parts between and after two blank lines."""
    try:
        raw = bytes(content or b"")
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    except (OSError, EOFError, zlib.error):
        return None, None
    parts = raw.decode("utf-8", "replace").split("\r\n\r\n", 2)
    return (parts[1], parts[2]) if len(parts) == 3 else (None, None)


def fetch_range(
    url: str, start: int | None = None, end: int | None = None, attempts: int = 5, unit: float = 1.5
) -> bytes | None:
    """Bytes ``start`` to ``end`` (inclusive) of a URL, or all; None if there is no such page."""
    request = urllib.request.Request(url)
    if start is not None:
        request.add_header("Range", f"bytes={start}-{end}")
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(request, timeout=120) as reply:
                return reply.read()
        except OSError as error:
            if getattr(error, "code", None) == 404:
                return None
            if attempt + 1 == attempts:
                raise
            time.sleep(unit * 2**attempt)
    return None


def size_of(url: str) -> int:
    """The length of a URL's content; 0 if it is not there or does not say."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as reply:
            return int(reply.headers.get("Content-Length") or 0)
    except OSError:
        return 0


def index_range(
    read: Callable[[int, int], bytes], size: int, prefix: str, probe: int = 1 << 16
) -> list[str]:
    """Lines of a sorted text whose key starts with ``prefix``, and the line before them.

    ``read`` gives the bytes from a place to another (exclusive).
    """
    from postpulse.sources.crawl_index import SortedText, after_prefix

    text = SortedText(read, size, probe)
    start, end = text.span(prefix, after_prefix(prefix))
    return [x.decode() for x in text.lines(start, end) if x] if end > start else []


def page_count(api: str, crawl: str, host: str) -> tuple[int, str | None]:
    """(pages that a crawl's index has for a host, None) or (0, why it could not be had)."""
    query = urllib.parse.urlencode({"url": f"{host}/*", "output": "json", "showNumPages": "true"})
    try:
        body = fetch_range(f"{api.format(crawl=crawl)}?{query}")
        return int(json.loads(body or b"{}").get("pages") or 0), None
    except (OSError, ValueError, AttributeError) as error:
        return 0, f"{type(error).__name__}: {error}"


def index_pages(
    spark: SparkSession, crawls: list[str], hosts: list[str], api: str, workers: int = 4
) -> DataFrame:
    """crawl, host, page and error of every page that a crawl index has for each host.

    ``api`` is the address with ``{crawl}`` in it.  Page counts are asked where
    tasks run; a host whose count fails is one row with a null page and the
    reason in ``error``, so that it cannot end a sweep and is not lost from it.
    """
    pairs = [(c, h) for c in crawls for h in hosts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [page_count(api, c, h) for c, h in zip(frame["crawl"], frame["host"], strict=True)]
            yield frame.assign(pages=[f[0] for f in found], error=[f[1] for f in found])

    asked = spark.createDataFrame(pairs, "crawl string, host string").repartition(workers)
    counted = asked.mapInPandas(run, "crawl string, host string, pages long, error string")
    numbers = F.when(F.col("pages") > 0, F.sequence(F.lit(0).cast("long"), F.col("pages") - 1))
    rows = counted.where("pages > 0 OR error IS NOT NULL")
    return rows.select("crawl", "host", F.explode_outer(numbers).alias("page"), "error")


def page_urls(pages: DataFrame, api: str, failures: str = "rows") -> DataFrame:
    """``pages`` (crawl, host, page, error) with one row for each URL that they list.

    A page that cannot be read, and a row that came with an error, is one row
    with a null URL and the reason in ``error``; with ``failures="raise"`` it
    ends the job instead.  Lines that do not parse are dropped.
    """
    columns = ["crawl", "host", "page", "url", "error"]

    def asked(crawl: str, host: str, page: int) -> Iterator[str]:
        query = urllib.parse.urlencode({"url": f"{host}/*", "output": "json", "fl": "url", "page": page})
        body = fetch_range(f"{api.format(crawl=crawl)}?{query}") or b""
        for line in body.decode("utf-8", "replace").splitlines():
            try:
                yield str(json.loads(line)["url"])
            except (ValueError, KeyError, TypeError):
                continue

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for crawl, host, page, error in frame[["crawl", "host", "page", "error"]].itertuples(index=False):
                if pd.isna(page):
                    rows.append((crawl, host, None, None, error))
                    continue
                try:
                    rows += [(crawl, host, page, url, None) for url in asked(crawl, host, int(page))]
                except OSError as failed:
                    if failures == "raise":
                        raise
                    rows.append((crawl, host, page, None, f"{type(failed).__name__}: {failed}"))
            found = pd.DataFrame(rows, columns=columns)
            yield found.astype({"page": "Int64"})

    return pages.mapInPandas(run, "crawl string, host string, page long, url string, error string")


def archived_payloads(found: DataFrame, base: str) -> DataFrame:
    """``found`` (filename, offset, length) with headers, body and error of each archived record.

    Each record is one ranged read below ``base``, where tasks run.  What
    cannot be read or does not parse has the reason in ``error``.
    """
    from postpulse.sources import stores

    def one(filename: str, offset: str, length: str) -> tuple[str | None, str | None, str | None]:
        try:
            start = int(offset)
            content = stores.read(stores.below(base, filename), start, start + int(length))
        except (OSError, TypeError, ValueError) as error:
            return None, None, f"{type(error).__name__}: {error}"
        headers, body = record_parts(content)
        return headers, body, None if body is not None else "not an archived record"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(*r) for r in frame[["filename", "offset", "length"]].itertuples(index=False)]
            names = ("headers", "body", "error")
            yield frame.assign(**{n: [r[k] for r in rows] for k, n in enumerate(names)})

    kept = found.drop("headers", "body", "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInPandas(run, f"{schema}, headers string, body string, error string")
