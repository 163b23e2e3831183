"""robots.txt verdicts (RFC 9309) and the audit ladder built on them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple[tuple[frozenset, tuple], ...]:
    """Groups of (agents, rules); rules are (allow, pattern) in file order.

    Consecutive agent lines open one group; any rule closes the list of agents.
    """
    groups: list[tuple[set, list]] = []
    open_agents = False
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_agents:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            open_agents = True
        elif name in ("allow", "disallow"):
            open_agents = False
            if groups and value:
                groups[-1][1].append((name == "allow", value))
    return tuple((frozenset(agents), tuple(rules)) for agents, rules in groups)


@lru_cache(maxsize=4096)
def _matcher(pattern: str) -> re.Pattern:
    anchored = pattern.endswith("$")
    body = ".*".join(map(re.escape, (pattern[:-1] if anchored else pattern).split("*")))
    return re.compile(body + (r"\Z" if anchored else ""), re.DOTALL)


def rules_for(text: str, agent: str) -> tuple[tuple[bool, str], ...] | None:
    """Rules of all groups for the agent's product, else of all for ``*``, else None."""
    product = agent.split("/")[0].lower()
    groups = parse(text)
    for wanted in (product, "*"):
        found = [rules for agents, rules in groups if wanted in agents]
        if found:
            return tuple(r for rules in found for r in rules)
    return None


def verdict(text: str | None, path: str | None, agent: str) -> tuple[bool, str, str | None]:
    """(allowed, reason, rule): the longest matching pattern decides, allow on a tie.

    A null path is the root.
    """
    path = path or "/"
    if text is None:
        return True, "no file", None
    rules = rules_for(text, agent)
    if rules is None:
        return True, "no group", None
    hits = [(len(p), allow, p) for allow, p in rules if _matcher(p).match(path)]
    if not hits:
        return True, "no rule", None
    _, allow, pattern = max(hits)
    return allow, "allow" if allow else "disallow", pattern


def robots_verdicts(rows: DataFrame, agent: str) -> DataFrame:
    """``rows`` (robots, path, ...) with allowed, reason and rule, in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text, path = (frame[c].where(frame[c].notna(), None) for c in ("robots", "path"))
            found = [verdict(x, p, agent) for x, p in zip(text, path, strict=True)]
            names = ["allowed", "reason", "rule"]
            yield frame.assign(**{n: [f[k] for f in found] for k, n in enumerate(names)})

    return rows.mapInPandas(run, f"{schema}, allowed boolean, reason string, rule string")


def audit_status(
    live_allowed: Column,
    live_present: Column,
    archived: Column,
    archived_disallow: Column,
    archived_refused: Column,
) -> Column:
    """The audit's ladder: a live ban, an archived one, never served, no archive, no live file, fine.

    ``archived_refused`` counts captures that answered with another status than
    200: the archive was there and found no file either.
    """
    return (
        F.when(live_present & ~live_allowed, "STOP-LIVE-DISALLOWS")
        .when(archived_disallow > 0, "STOP-ARCHIVE-DISALLOWS")
        .when((archived == 0) & (archived_refused > 0), "OK-NEVER-SERVED")
        .when(archived == 0, "UNVERIFIED-NO-ARCHIVE")
        .when(~live_present, "OK-NO-LIVE-FILE")
        .otherwise("OK")
    )


def audit(live: DataFrame, evidence: DataFrame, agent: str) -> DataFrame:
    """provider, path, status, copies, disallowing and refused of each audited provider.

    ``live`` has provider, path, http_status and robots (null: none served);
    ``evidence`` has provider, kind and body, as ``sources.evidence`` gathers it.
    """
    paths = live.select("provider", "path")
    copies = evidence.where("kind = 'copy'").join(paths, "provider").withColumnRenamed("body", "robots")
    judged = robots_verdicts(copies.select("provider", "path", "robots"), agent)
    by_copy = judged.groupBy("provider").agg(
        F.count("*").alias("copies"), F.count_if(~F.col("allowed")).alias("disallowing")
    )
    refused = evidence.groupBy("provider").agg(F.count_if(F.col("kind") == "refused").alias("refused"))
    now = robots_verdicts(live.select("provider", "path", "http_status", "robots"), agent)
    counts = ["copies", "disallowing", "refused"]
    rows = now.join(by_copy, "provider", "left").join(refused, "provider", "left").fillna(0, counts)
    present = (F.col("http_status") == 200) & F.col("robots").isNotNull()
    status = audit_status(F.col("allowed"), present, *map(F.col, counts))
    return rows.select("provider", "path", status.alias("status"), *counts)
