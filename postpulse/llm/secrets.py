"""Operator 1: secret scan with one combined automaton."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postpulse.llm import automaton
from postpulse.llm.common import map_batches, picked

SCHEMA = "doc_id {id}, spans array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` for the automaton; ``check`` must match a whole found text."""

    kind: str
    pattern: str
    check: str | None = None


# The three base rules.  The lengths of access keys and hex runs
# are part of the automaton, as a run too short holds no longer one; for
# assignments a short value still uses up its text, so length is checked after.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""(?s:[A-Za-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,})""",
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Counted repeats multiply the states of a combined automaton; here lengths are
# left to ``check``.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r".{40,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=~-]+", r".{23,}"),
    Rule("login_url", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


class Scanner:
    """Compiled rules; small enough to travel with the task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [automaton.parse(r.pattern) for r in rules]
        self.backward = automaton.compile_rules(
            [automaton.reversed_tree(t) for t in trees], search=True
        )
        self.forward = [automaton.compile_rules([t], search=False) for t in trees]

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text in code points, by start, then by rule."""
        found: list[list] = [[] for _ in texts]
        buffer = bytes([automaton.SEPARATOR]).join(texts)
        at, bits = automaton.starts(self.backward, buffer)
        if not len(at):
            return found
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        owner = np.searchsorted(begins, at, side="right") - 1
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            doc = int(owner[low])
            here, masks = (at[low:high] - begins[doc]).tolist(), bits[low:high].tolist()
            found[doc] = self._spans(texts[doc], here, masks)
        return found

    def _spans(self, text: bytes, at: list[int], masks: list[int]) -> list[tuple[str, int, int]]:
        spans = []
        free = [0] * len(self.rules)
        for start, mask in zip(at, masks, strict=True):
            while mask:
                k = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if start < free[k]:
                    continue
                free[k] = end = automaton.longest(self.forward[k], text, start)
                check = self.rules[k].check
                if check and not re.fullmatch(check.encode(), text[start:end]):
                    continue
                spans.append((start, k, end))
        if not spans:
            return []
        marks = np.frombuffer(text, dtype=np.uint8)
        points = np.cumsum((marks & 0xC0) != 0x80)
        before = lambda p: int(points[p - 1]) if p else 0
        return [(self.rules[k].kind, before(s), before(e)) for s, k, e in sorted(spans)]


@lru_cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and its spans (kind, start, end), one row for each row of ``df``.

    Matches are leftmost-longest and do not overlap within a rule; offsets
    count code points, the end is exclusive.  Null and empty texts have no
    spans; an empty table gives an empty one.  No shuffle: texts never leave
    the task that read them.
    """
    scanner = compiled(rules)
    rows = picked(df, doc_id=id_col, text=text_col)
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        spans = [
            [{"kind": k, "start": s, "end": e} for k, s, e in own] for own in scanner.scan(texts)
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, type=pa.list_(kind))], names=["doc_id", "spans"]
        )

    return map_batches(rows, work, schema)
