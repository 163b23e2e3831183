"""The combined automaton against ``re``, and the scan's edge cases."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postpulse.llm import automaton, secrets
from postpulse.llm.common import span_digest
from tests.llm.conftest import make

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text: str) -> list[tuple[str, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secrets.BASE_KINDS[k], s, e) for s, k, e in sorted(found)]


def base(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    found = secrets.compiled(secrets.RULES).scan([t.encode() for t in texts])
    return [[s for s in own if s[0] in secrets.BASE_KINDS] for own in found]


CASES = [
    "",
    "token=secret: abcdefghijklmnop",
    "API_KEY = 'abcdefghijkl' é",
    "éé passWord:\"0123456789abcdef0123",
    "AKIA" * 6 + "0123456789abcdef" * 3,
    "secret==============",
    "token=" + "a" * 50_000,
    "token" + " " * 9000 + "=abcdefghijklmnop",
    "f" * 70_000,
]


def test_cases_match_re():
    assert base(CASES) == [brute(t) for t in CASES]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="tokenTOKEN=: 'AKI0f_é", max_size=60), max_size=8))
def test_random_texts_match_re(texts):
    assert base(texts) == [brute(t) for t in texts]


@given(st.binary(max_size=400).map(lambda b: bytes(x % 3 + 97 for x in b)))
@settings(max_examples=100, deadline=None)
def test_lanes_agree_with_one_lane(data):
    dfa = automaton.compile_rules(
        [automaton.reversed_tree(automaton.parse(p)) for p in ("ab{3}", "a(b|c)*c", "[^a]c+")], True
    )
    one, many = automaton.starts(dfa, data, lanes=1), automaton.starts(dfa, data * 1, lanes=64)
    assert [x.tolist() for x in one] == [x.tolist() for x in many]
    expected = {
        k: [m for m in range(len(data)) if re.compile(p.encode()).match(data, m)]
        for k, p in enumerate(("ab{3}", "a(?:b|c)*c", "[^a]c+"))
    }
    for k, at in expected.items():
        assert [p for p, bits in zip(*(x.tolist() for x in one), strict=True) if bits >> k & 1] == at


def test_minimisation_merges_equal_states():
    dfa = automaton.compile_rules([automaton.parse("(ab|cb)d"), automaton.parse("ab")], False)
    assert dfa.states == 7
    with pytest.raises(ValueError, match="empty"):
        automaton.compile_rules([automaton.parse("a*")], False)


def test_query_columns_and_edges(spark, corpus):
    rows = [*corpus, (1000, "token = abcdefghijklmnop"), (1000, "token = abcdefghijklmnop"), (None, "f" * 20)]
    found = span_digest(secrets.find_secrets(make(spark, rows)), secrets.BASE_KINDS).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1000].n_assign == 1 and by_id[1000].spans == "assign:0:24"
    assert by_id[None].n_hex == 1
    quiet = [r for r in found if r.doc_id is not None and r.doc_id < 1000]
    assert not any(r.spans for r in quiet)


def test_more_kinds_are_added(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- bearer 0123456789abcdef0123 ftp://me:pw@host.io"
    rows = secrets.find_secrets(make(spark, [(1, text)])).first().spans
    assert [s.kind for s in rows] == ["pem", "bearer", "hex", "login_url"]


def test_empty_table(no_documents):
    assert secrets.find_secrets(no_documents).count() == 0


PIECES = [
    "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "eyJ", "eyJhbGciOi", ".", "abc_-9", "J9" * 12, "bearer", "Bearer ", " ",
    "x" * 23, "~=/", "ftp", "://", "user", ":", "p%40", "@", "host.io", "é", "\n", "BEGIN",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6))
def test_more_kinds_match_re(texts):
    """Leftmost, longest, not overlapping within a kind; what fails its check still uses up its text."""
    found = secrets.compiled(secrets.RULES).scan([t.encode() for t in texts])
    kinds = [r.kind for r in secrets.RULES]
    for text, own in zip(texts, found, strict=True):
        wanted = [
            (m.start(), kinds.index(rule.kind), m.end())
            for rule in secrets.MORE_RULES
            for m in re.finditer(rule.pattern, text, re.ASCII)
            if not rule.check or re.fullmatch(rule.check, m[0])
        ]
        extra = [s for s in own if s[0] not in secrets.BASE_KINDS]
        assert extra == [(kinds[k], s, e) for s, k, e in sorted(wanted)]
