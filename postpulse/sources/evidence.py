"""Evidence about vendors, gathered where tasks run, and no more of it than is needed.

Each provider is one row and one task asks for it in order: its boards until
one answers, its crawls from the newest on until enough copies are found.
What is asked never depends on other providers, so providers run side by side.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.sources import crawl, stores
from postpulse.sources.crawl_index import SortedText, records_under

#: Boards of a provider that are tried; copies that are wanted; crawls that are searched.
TENANTS, COPIES, CRAWLS = 40, 3, 10
ROBOTS = "/robots.txt"


def status_of(url: str) -> int:
    """The HTTP status of an address, or 0 if no answer comes."""
    try:
        with urllib.request.urlopen(url, timeout=20) as reply:
            return reply.status
    except urllib.error.HTTPError as error:
        return error.code
    except OSError:
        return 0


def live_tenants(
    boards: DataFrame, most: int = TENANTS, status: Callable[[str], int] = status_of
) -> DataFrame:
    """provider, token (the first that answers, else null) and asked, the number of boards tried.

    ``boards`` has provider, place, token and probe (an address).  The first
    ``most`` by place (ties: token) are tried in turn until one answers 200;
    null places come last, rows without a probe are passed over.
    """
    order = Window.partitionBy("provider").orderBy(F.asc_nulls_last("place"), "token")
    first = boards.where(F.col("probe").isNotNull()).select(
        "provider", "token", "probe", F.row_number().over(order).alias("n")
    ).where(F.col("n") <= most)
    each = F.array_sort(F.collect_list(F.struct("n", "token", "probe"))).alias("tries")
    rows = first.groupBy("provider").agg(each)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for provider, tries in frame.itertuples(index=False):
                token, asked = None, 0
                for one in tries:
                    asked += 1
                    if status(one["probe"]) == 200:
                        token = one["token"]
                        break
                found.append((provider, token, asked))
            yield pd.DataFrame(found, columns=["provider", "token", "asked"])

    return rows.mapInPandas(run, "provider string, token string, asked int")


def archived_copies(
    targets: DataFrame,
    base: str,
    crawls: list[str],
    wanted: int = COPIES,
    most: int = CRAWLS,
) -> DataFrame:
    """One row for each archived robots file, refusal and failed search of a provider's hosts.

    ``targets`` has provider, prefix (of the index's keys) and tenant (whose
    host is preferred within a block; may be null).  ``base`` holds
    ``cc-index/collections/<crawl>/indexes`` and the archives.  Crawls are
    searched in the order given, ``most`` of those that exist at most, until
    ``wanted`` copies that answered 200 are found; of a host that has been
    found no second copy is taken.  ``kind`` is copy, refused (another
    status), failed (reason in ``error``) or searched, whose one row for each
    provider has the number of crawls in ``crawls_searched``.
    """
    fields = "provider string, kind string, crawl string, url string, timestamp string, status string, filename string, offset long, length long, body string, error string, crawls_searched int"
    names = [f.split()[0] for f in fields.split(", ")]

    def gathered(provider: str, prefix: str, tenant: str | None) -> list[dict]:
        rows: list[dict] = []
        hosts: set[str] = set()
        copies = searched = 0
        for name in crawls:
            if copies >= wanted or searched >= most:
                break
            folder = stores.below(base, "cc-index/collections", name, "indexes")
            address = stores.below(folder, "cluster.idx")
            if not (size := stores.size(address)):
                continue
            searched += 1
            text = SortedText(lambda s, e, a=address: stores.read(a, s, e), size)
            for found in records_under(text, folder, prefix):
                if copies >= wanted:
                    break
                if isinstance(found, str):
                    rows.append({"kind": "failed", "crawl": name, "error": found})
                    continue
                robots = [r for r in found if urlsplit(r["url"]).path.endswith(ROBOTS)]
                rows += [{**r, "kind": "refused", "crawl": name} for r in robots if r["status"] != "200"]
                good = [r for r in robots if r["status"] == "200"]
                good.sort(key=lambda r: not (urlsplit(r["url"]).hostname or "").startswith(f"{tenant}."))
                for r in good:
                    host = urlsplit(r["url"]).hostname or ""
                    if copies >= wanted:
                        break
                    if host in hosts:
                        continue
                    try:
                        start = int(r["offset"])
                        raw = stores.read(stores.below(base, r["filename"]), start, start + int(r["length"]))
                        _, body = crawl.record_parts(raw)
                    except (OSError, TypeError, ValueError) as error:
                        rows.append({**r, "kind": "failed", "crawl": name, "error": f"{type(error).__name__}: {error}"})
                        continue
                    if body is None:
                        rows.append({**r, "kind": "failed", "crawl": name, "error": "not an archived record"})
                        continue
                    hosts.add(host)
                    copies += 1
                    rows.append({**r, "kind": "copy", "crawl": name, "body": body})
        return [*rows, {"kind": "searched", "crawls_searched": searched}]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                {**row, "provider": provider}
                for provider, prefix, tenant in frame.itertuples(index=False)
                for row in gathered(provider, prefix, tenant)
            ]
            found = pd.DataFrame(rows).reindex(columns=names)
            for c in ("offset", "length", "crawls_searched"):
                found[c] = pd.to_numeric(found[c], errors="coerce").astype("Int64")
            yield found.astype({c: object for c in names if c not in ("offset", "length", "crawls_searched")})

    return targets.select("provider", "prefix", "tenant").repartition("provider").mapInPandas(run, fields)
