"""Reading live boards: one HTTP request each, with retries, from the executors.

The plan decides concurrency: a partition is one worker, which pauses between
the starts of its requests.  What a reply means is decided by Columns
(``roster.probe_status``), so the reader only reports it.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postpulse.functions.text import quoted
from postpulse.operators.roster import probe_status
from postpulse.sources.vendors import VENDORS

#: Why a board was not asked when time had run out.
DEADLINE = "deadline"
REPLY = "source string, company string, http int, body string, reason string"

# Addresses of the vendors' public board documents.
ENDPOINTS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{}/jobs?content=true",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{}?includeCompensation=true",
    "lever": "https://api.lever.co/v0/postings/{}?mode=json",
    "workable": "https://apply.workable.com/api/v1/widget/accounts/{}?details=true",
    "breezy": "https://{}.breezy.hr/json",
    "recruitee": "https://{}.recruitee.com/api/offers/",
    "teamtailor": "https://{}.teamtailor.com/jobs.json",
}
# Attempts, and the pause after a refusal and after a failure.
ATTEMPTS, REFUSED_PAUSE, FAILED_PAUSE = 4, 1.5, 1.0


def api_url(source: Column, company: Column, endpoints: dict[str, str] = ENDPOINTS) -> Column:
    """The address of a board's document; null for unknown sources and boards without a name."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, address in endpoints.items():
        before, after = address.split("{}")
        found = found.when(source == name, F.concat(F.lit(before), quoted(company), F.lit(after)))
    return F.when(F.coalesce(company, F.lit("")) != "", found)


def fetch(url: str, timeout: float, unit: float = 1.0) -> tuple[int | None, str | None, str | None]:
    """(status, body, reason); refusals and failures are tried again, twice as late each time."""
    status = reason = None
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as reply:
                return reply.status, reply.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as error:
            status, reason = error.code, error.reason
            if status not in (403, 429) and status < 500:
                return status, None, reason
            pause = REFUSED_PAUSE
        except OSError as error:
            status, reason, pause = None, str(error), FAILED_PAUSE
        if attempt + 1 < ATTEMPTS:
            time.sleep(unit * pause * 2**attempt)
    return status, None, reason


def read_boards(
    boards: DataFrame,
    workers: int = 8,
    pause: float = 0.0,
    timeout: float = 30.0,
    endpoints: dict[str, str] = ENDPOINTS,
    unit: float = 1.0,
    until: float | None = None,
) -> DataFrame:
    """Replies for (source, company) pairs; write them down before using them twice.

    Boards of unknown sources and boards without a name are left out.  ``until``
    is a deadline in seconds since 1970: no request starts behind it, and the
    boards that were not asked come back with the reason ``deadline``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, company in zip(frame["source"], frame["company"], strict=True):
                if until is not None and time.time() >= until:
                    rows.append((source, company, None, None, DEADLINE))
                    continue
                started = time.monotonic()
                url = endpoints[source].format(urllib.parse.quote(company, safe="!'()*"))
                rows.append((source, company, *fetch(url, timeout, unit)))
                time.sleep(max(0.0, pause - (time.monotonic() - started)))
            out = pd.DataFrame(rows, columns=["source", "company", "http", "body", "reason"])
            out["http"] = out["http"].astype("Int32")
            yield out

    known = boards.select("source", "company").where(F.col("source").isin(*endpoints))
    known = known.where(F.coalesce("company", F.lit("")) != "")
    return known.repartition(workers).mapInPandas(run, REPLY)


def with_progress(replies: DataFrame) -> tuple[DataFrame, Observation]:
    """``replies``, and an observation of how much of the plan an action on them ran."""
    seen = Observation("boards")
    asked = F.coalesce("reason", F.lit("")) != DEADLINE
    watched = replies.observe(
        seen,
        F.count("*").alias("units_planned"),
        F.count_if(asked).alias("units_completed"),
        F.count_if(asked & F.col("body").isNull()).alias("units_failed"),
    )
    return watched, seen


def run_stats(seen: Observation) -> dict[str, int | bool]:
    """Planned, completed and failed units of a finished action, and whether all were completed."""
    found = seen.get
    return {**found, "complete": found["units_completed"] >= found["units_planned"]}


def probed(replies: DataFrame) -> DataFrame:
    """Replies with the number of jobs listed and the verdict on the board."""
    path = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, vendor in VENDORS.items():
        found = F.get_json_object("body", f"$.{vendor.listing}" if vendor.listing else "$")
        path = path.when(F.col("source") == name, found)
    shape_ok = F.coalesce(F.ltrim(path).startswith("["), F.lit(False))
    jobs = F.when(shape_ok, F.json_array_length(path)).cast("long")
    return replies.withColumns({"jobs": jobs, "status": probe_status(F.col("http"), shape_ok, jobs)})
