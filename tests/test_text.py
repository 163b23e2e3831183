"""Scalar functions on hand-made cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from postpulse.functions import lexicons as lex
from postpulse.functions import text


def value(spark, column, **columns):
    row = [tuple(columns.values())]
    frame = spark.createDataFrame(row, ", ".join(f"{c} string" for c in columns))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "level"),
    [
        ("Software Engineering Intern", "intern"),
        ("Principal Director", "principal"),
        ("Director of Staffing", "executive"),
        ("Sr. Nurse", "senior"),
        ("Entry-level clerk", "junior"),
        ("Leadership coach", "mid"),
        (None, "mid"),
    ],
)
def test_seniority(spark, title, level):
    assert value(spark, text.seniority("t"), t=title) == level


@pytest.mark.parametrize(
    ("body", "low", "high", "currency"),
    [
        ("$150,000 - $200,000", 150000, 200000, "USD"),
        ("£70k–£90k", 70000, 90000, "GBP"),
        ("€80.000 - €100.000", 80000, 100000, "EUR"),
        ("C$100,000 to C$120,000", 100000, 120000, "CAD"),
        ("120000-160000 USD", None, None, None),
        ("$5,000 - $9,000", None, None, None),
        ("$90k - $80k", None, None, None),
        ("", None, None, None),
    ],
)
def test_salary(spark, body, low, high, currency):
    found = value(spark, text.salary("b"), b=body)
    assert tuple(found) == (low, high, currency)


def test_html_entities_decode_once_and_tags_leave_spaces(spark):
    html = "<p>A&amp;lt;b&nbsp;<b>Specialist</b>.</p>&#39;"
    assert value(spark, text.strip_html("h"), h=html) == "A<b Specialist . &#39;"


def test_decode_keeps_plus_and_bad_escapes(spark):
    assert value(spark, text.decode_or_raw("h"), h="a%20b+c") == "a b+c"
    assert value(spark, text.decode_or_raw("h"), h="100%") == "100%"


def test_places_agree_across_spellings(spark):
    pair = [value(spark, text.normal_place("p"), p=p) for p in ("Chicago, IL", "IL - Chicago (Remote)")]
    assert pair == ["chicago il", "chicago il"]
    assert value(spark, text.normal_place("p"), p="Remote - US") == ""
    assert value(spark, text.normal_place("p"), p=None) == ""


@pytest.mark.parametrize(
    ("title", "place", "says"),
    [
        ("Driver - Leeds", "Leeds, UK", "geographic"),
        ("Driver - Night Shift", "Leeds, UK", "not_geographic"),
        ("Driver - Leeds", None, "unstated"),
        ("Driver", "Leeds", "uninformative"),
        ("Driver - Remote", "Leeds", "uninformative"),
    ],
)
def test_fanout_verdict(spark, title, place, says):
    assert value(spark, text.fanout_verdict("t", "p"), t=title, p=place) == says


@pytest.mark.parametrize(
    ("url", "token"),
    [
        ("https://x.example/Acme/jobs/1", "acme"),
        ("https://x.example/embed/acme", None),
        ("https://x.example/12345", None),
        ("https://x.example/", None),
        ("not a url", None),
        ("https://x.example/a%20b", None),
    ],
)
def test_token_from_path(spark, url, token):
    assert value(spark, text.token_from_url("u"), u=url) == token


def test_token_from_subdomain(spark):
    def found(url):
        column = text.token_from_url("u", token_from="subdomain", host="vendor.hr")
        return value(spark, column, u=url)

    assert found("https://Acme.vendor.hr/p/1") == "acme"
    assert found("https://a.b.vendor.hr/") is None
    assert found("https://www.vendor.hr/") is None
    assert found("https://a.vendor.hr.evil.com/") is None


def test_guarded_technologies_need_a_technical_title(spark):
    column = F.array_join(text.technologies("b", "c"), ",")
    assert value(spark, column, b="React and Python", c="Store Manager") == "Python"
    assert value(spark, column, b="React and Python", c="Developer") == "Python,React"
    assert value(spark, column, b="mail php@x.io", c="Developer") == ""


def test_volunteer_guard(spark):
    for title, unpaid in (
        ("Volunteer Programme", True),
        ("Volunteer Programs Specialist", False),
        ("Director of Volunteer Engagement", False),
        ("Unpaid intern", True),
    ):
        assert value(spark, text.is_volunteer_listing("t"), t=title) is unpaid


def test_wilson(spark):
    frame = spark.createDataFrame([(0, 0), (5, 5)], "k int, n int")
    rows = frame.select(text.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert tuple(rows[0].w) == (0.0, 1.0)
    assert rows[1].w.low == pytest.approx(0.5655, abs=1e-3) and rows[1].w.high == 1.0


@pytest.mark.parametrize(
    ("title", "family"),
    [
        ("Break free of the 9-5!", "suspect_recruitment_ad"),
        ("German Language Specialist (Freelance AI Trainer Project)", "ai_gig_work"),
        ("Group Fitness Instructor", "fitness_wellness"),
        ("Maintenance Engineer", "engineering_nonsoftware"),
        ("RN - Night Shift", "healthcare"),
        ("Substitute Teacher", "education"),
        ("Conference Room AV Technician", "skilled_trades"),
        ("Event Producer", "events"),
        ("Video Editor", "media_production"),
        ("Trial Attorney", "corporate"),
        ("Help Desk", "support"),
        ("Commercial·e terrain indépendant", "non_english"),
        ("Engineer II", "engineering"),
        ("Supervisor", "generic"),
        ("Blacksmith", "other"),
    ],
)
def test_title_lexicon_is_whole(spark, title, family):
    assert value(spark, text.classify_title("t"), t=title) == family
    assert (value(spark, text.title_key("t"), t=title) or {"family": "other"})["family"] == family


@pytest.mark.parametrize(
    ("token", "family", "key"),
    [
        ("thomasvillechildcare", "education", "childcare"),
        ("australianenergymarketoperator", None, None),
        ("irongym", "fitness_wellness", "gym"),
        ("burbankpizza", "retail_food", "pizza"),
        ("delawareclaw", None, None),
        ("parnalllaw", "corporate", "law"),
        ("springhealth", "healthcare", "health"),
        ("acmetrucking", "logistics", "trucking"),
        ("cityvetinc", "healthcare", "vet"),
    ],
)
def test_token_lexicon_is_whole(spark, token, family, key):
    found = value(spark, text.classify_token("t"), t=token)
    assert (found["family"] if found else None, found["key"] if found else None) == (family, key)


def test_lexicon_sizes():
    assert len(lex.TITLE_FAMILIES) == 22
    assert len({f for f, _ in lex.TITLE_FAMILIES}) == 20
    assert sum(len(keys) for _, keys in lex.TITLE_FAMILIES) == 511
    assert len(lex.TOKEN_KEYS) == 81


def test_leading_words_begin_every_match():
    import re

    from postpulse.functions import lexicons as lex

    wanted = {
        r"\breact(?:\.js)?\b": ("react",), r"\bpower ?bi\b": ("power",), r"\bllms?\b": ("llm",),
        r"\bc#|\bc sharp\b": (), r"\b(?:aws|gcp)\b": ("aws", "gcp"), r"\b(?:apache )?spark\b": ("apache", "spark"),
        r"(?:\.net\b|\bdotnet\b)": (), r"\b(?:k8s|large language model)s?\b": ("k8s", "large"),
    }
    assert {p: text.leading_words(p) for p in wanted} == wanted
    sample = " react.js powerbi llms spark apache spark k8s ruby on rails go lang mongodb nodejs sveltekit c++ "
    for _, pattern, _ in lex.TECHNOLOGIES:
        for found in re.finditer(pattern, sample):
            assert not text.leading_words(pattern) or found[0].startswith(text.leading_words(pattern))


def test_word_trie_takes_the_longest():
    import re

    words = ["java", "javascript", "go", "golang", "google", "c"]
    trie = re.compile(rf"\b({text.word_trie(words)})")
    for word in words:
        assert trie.match(word)[0] == word and trie.match(f"{word}!")[0] == word
    assert trie.findall("javas gol xgo cobol") == ["java", "go", "c"]


@pytest.mark.parametrize(
    ("token", "stripped"),
    [
        ("Acme-Jobs_Inc 99", "acme"),
        ("abus", "abus"),
        ("ab1us", "ab"),
        ("abcus", "abc"),
        ("co", "co"),
        ("x12", "x"),
        ("12", ""),
        ("abcjobsinc7llc", "abc"),
        ("jobsinc", "jobs"),
        ("incinc", "inc"),
        ("", ""),
        (None, None),
    ],
)
def test_endings_go_while_three_characters_stay(spark, token, stripped):
    assert value(spark, text.without_suffixes("t"), t=token) == stripped


def _seconds(spark, column, token):
    value(spark, column, t="warm")
    start = time.monotonic()
    found = value(spark, column, t=token)
    return found, time.monotonic() - start


def test_blocked_keys_take_one_pass(spark):
    token = "career" * 2000 + "x"
    found, seconds = _seconds(spark, text.classify_token("t"), token)
    assert found is None and seconds < 5
    found, seconds = _seconds(spark, text.classify_token("t"), token + "care")
    assert found["key"] == "care" and seconds < 5


def test_many_endings_take_one_pass(spark):
    found, seconds = _seconds(spark, text.without_suffixes("t"), "abc" + "jobs" * 3000)
    assert found == "abc" and seconds < 5


def test_tokens_without_endings_take_one_pass(spark):
    found, seconds = _seconds(spark, text.without_suffixes("t"), "acme" * 3000)
    assert found == "acme" * 3000 and seconds < 5
