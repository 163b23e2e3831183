"""The pages of a crawl's query service as a resumable stream, ``readStream.format("crawl_pages")``.

The stream hands out pages (crawl, host, page) a few at a time; ``page_urls``
of ``sources.crawl`` then reads them where tasks run.  The offset names the
next page, so a stream that stops (a page that cannot be read ends the query
when ``page_urls`` raises) goes on with the very batch that failed: no page is
lost, and none that was committed is asked again.

Options: ``api`` (address with ``{crawl}`` in it), ``crawls`` and ``hosts``
(comma-separated), ``pages_per_batch``.  A host whose number of pages cannot
be had is one row with a null page and the reason in ``error``; the sweep goes
on with the next.  Every batch asks for one number of pages at most for each
host that it passes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from postpulse.sources import crawl

SCHEMA = "crawl string, host string, page long, error string"


class PageReader(ds.SimpleDataSourceStreamReader):
    """Offsets: ``pair`` (place in crawls x hosts), ``page`` (the next one), ``pages`` (of that pair; -1: not asked).

    ``counts`` are the numbers of pages of the pairs that a batch finished,
    from its first on, so that the batch can be given out again as it was.
    """

    def __init__(self, options: dict[str, str]):
        crawls, hosts = ([x.strip() for x in options[k].split(",") if x.strip()] for k in ("crawls", "hosts"))
        self.pairs = [(c, h) for c in crawls for h in hosts]
        self.api = options["api"]
        self.most = int(options.get("pages_per_batch", 100))

    def initialOffset(self) -> dict:
        return {"pair": 0, "page": 0, "pages": -1, "counts": "", "failed": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        pair, page, pages = (int(start[k]) for k in ("pair", "page", "pages"))
        counts: list[str] = []
        failed: list[str] = []
        given = 0
        while pair < len(self.pairs) and given < self.most:
            if pages < 0:
                pages, error = crawl.page_count(self.api, *self.pairs[pair])
                if error:
                    failed.append(f"{pair}:{error}".replace("\n", " "))
                    given += 1
            taken = min(pages - page, self.most - given)
            page, given = page + taken, given + taken
            if page >= pages:
                counts.append(str(pages))
                pair, page, pages = pair + 1, 0, -1
        end = {
            "pair": pair, "page": page, "pages": pages,
            "counts": ",".join(counts), "failed": "\n".join(failed),
        }
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        counts = [int(c) for c in end["counts"].split(",") if c]
        failed = dict(line.split(":", 1) for line in end["failed"].split("\n") if line)
        rows: list[tuple] = []
        first, page = int(start["pair"]), int(start["page"])
        for pair in range(first, int(end["pair"]) + 1):
            if pair >= len(self.pairs):
                break
            last = counts[pair - first] if pair < int(end["pair"]) else int(end["page"])
            if str(pair) in failed:
                rows.append((*self.pairs[pair], None, failed[str(pair)]))
            rows += [(*self.pairs[pair], k, None) for k in range(page, last)]
            page = 0
        return iter(rows)


class CrawlPages(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_pages"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CrawlPages)
