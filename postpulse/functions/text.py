"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.functions import lexicons as lex

#: White space as browsers' scripting language counts it; Java's \\s is ASCII.
WIDE_SPACE = r"[\s ﻿  -     　]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(text: Column, rules, default: Column) -> Column:
    """The label of the first pattern found, case-insensitively."""
    ascii_only = ascii_words(text)
    found = F.when(F.lit(False), default)
    for label, pattern in rules:
        found = found.when(ascii_only.rlike(f"(?i){pattern}"), F.lit(label))
    return found.otherwise(default)


def ascii_words(text: Column | str) -> Column:
    """Non-ASCII characters as spaces, so that \\b falls where it does in ASCII engines."""
    return F.regexp_replace(_col(text), r"[^\x00-\x7F]", " ")


def normal_title(title: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, no outer spaces."""
    text = F.lower(F.coalesce(_col(title), F.lit("")))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def quoted(part: Column | str) -> Column:
    """A path's part percent-encoded: a space is %20, and ! ' ( ) ~ * stay."""
    found = F.replace(F.url_encode(_col(part)), F.lit("+"), F.lit("%20"))
    for char in "!'()~":
        found = F.replace(found, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return found


def padded_title(title: Column | str) -> Column:
    return F.concat(F.lit(" "), normal_title(title), F.lit(" "))


def any_phrase(title: Column | str, phrases) -> Column:
    padded = padded_title(title)
    return reduce(lambda a, b: a | b, [padded.contains(p) for p in phrases])


def is_recruitment_ad(title: Column | str) -> Column:
    return any_phrase(title, lex.RECRUITMENT_PHRASES)


def is_volunteer_listing(title: Column | str) -> Column:
    staff = padded_title(title).rlike(lex.VOLUNTEER_STAFF)
    return ~staff & any_phrase(title, lex.VOLUNTEER_PHRASES)


def seniority(title: Column | str) -> Column:
    return first_match(F.coalesce(_col(title), F.lit("")), lex.SENIORITY, F.lit("mid"))


def workplace(text: Column | str, stated: Column | None = None) -> Column:
    """An explicit remote, hybrid or onsite wins; else hybrid words, remote words, onsite."""
    guessed = first_match(
        F.coalesce(_col(text), F.lit("")),
        (("hybrid", lex.HYBRID), ("remote", lex.REMOTE)),
        F.lit("onsite"),
    )
    if stated is None:
        return guessed
    low = F.lower(stated)
    return F.when(low.isin("remote", "hybrid", "onsite"), low).otherwise(guessed)


def amount(raw: Column) -> Column:
    """``150k`` or ``150,000`` as a number; null if it is neither."""
    text = F.trim(raw)
    thousands = F.regexp_replace(text, r"\s*[kK]$", "").try_cast("double")
    plain = F.regexp_replace(text, r"[,.\s]", "").try_cast("bigint")
    scaled = F.floor(thousands * 1000 + 0.5).cast("bigint")
    return F.when(text.rlike("[kK]$"), scaled).otherwise(plain)


def salary(text: Column | str) -> Column:
    """struct(salary_min, salary_max, salary_currency): the widest plausible range, first on ties."""
    body = F.coalesce(_col(text), F.lit(""))
    pattern = F.lit(lex.SALARY_RANGE)
    groups = [F.regexp_extract_all(body, pattern, F.lit(k)) for k in range(1, 5)]
    ranges = F.transform(
        F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups, 1)]),
        lambda z: F.struct(
            amount(z["g2"]).alias("low"),
            amount(z["g4"]).alias("high"),
            F.coalesce(F.nullif(z["g1"], F.lit("")), z["g3"]).alias("symbol"),
        ),
    )
    fit = F.filter(
        ranges,
        lambda r: (r["low"] >= lex.SALARY_LEAST)
        & (r["high"] > r["low"])
        & (r["high"] <= lex.SALARY_MOST),
    )
    start = F.struct(
        F.lit(None).cast("bigint").alias("low"),
        F.lit(None).cast("bigint").alias("high"),
        F.lit(None).cast("string").alias("symbol"),
    )
    best = F.aggregate(
        fit,
        start,
        lambda a, r: F.when(
            a["low"].isNull() | (r["high"] - r["low"] > a["high"] - a["low"]), r
        ).otherwise(a),
    )
    names = F.create_map(*[F.lit(x) for pair in lex.CURRENCIES.items() for x in pair])
    return F.struct(
        best["low"].alias("salary_min"),
        best["high"].alias("salary_max"),
        F.try_element_at(names, best["symbol"]).alias("salary_currency"),
    )


def period_salary(salary_struct: Column) -> Column:
    """A structured yearly salary whose ends are strings; either may be missing."""
    def end(name: str) -> Column:
        value = F.regexp_replace(salary_struct[name].cast("string"), r"[,\s]", "")
        number = value.try_cast("double")
        return F.when(number > 0, F.floor(number + 0.5).cast("bigint"))

    low, high = end("min"), end("max")
    stated = (salary_struct["period"] == "year") & (low.isNotNull() | high.isNotNull())
    return F.struct(
        F.when(stated, low).alias("salary_min"),
        F.when(stated, high).alias("salary_max"),
        F.when(stated, F.nullif(salary_struct["currency"], F.lit(""))).alias("salary_currency"),
    )


def strip_html(html: Column | str) -> Column:
    """Tags as spaces, four entities decoded in a fixed order, white space collapsed."""
    text = F.regexp_replace(F.coalesce(_col(html), F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(
        F.regexp_replace(text, f"{WIDE_SPACE}+", " "), "^ | $", ""
    )


def decode_or_raw(text: Column | str) -> Column:
    """Percent-decoded, or as it was where that fails; a plus sign stays one."""
    raw = _col(text)
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def timestamp_or_null(text: Column | str) -> Column:
    return _col(text).try_cast("timestamp")


def place_tokens(location: Column | str) -> Column:
    """Distinct words of a place, sorted, without those that say nothing."""
    words = F.split(normal_title(location), " ")
    noise = F.array(*map(F.lit, [*lex.LOCATION_NOISE, ""]))
    return F.array_sort(F.array_except(words, noise))


def normal_place(location: Column | str) -> Column:
    """Two spellings of a place agree; the empty string means unstated."""
    return F.array_join(place_tokens(location), " ")


def title_parts(title: Column | str) -> Column:
    """The title cut at dashes, bars, brackets and commas, each part normalised."""
    pieces = F.split(
        F.coalesce(_col(title), F.lit("")), rf"{WIDE_SPACE}+[-–—|(]{WIDE_SPACE}*|{WIDE_SPACE}*,{WIDE_SPACE}*"
    )
    return F.filter(F.transform(pieces, normal_title), lambda p: p != "")


def stem_of(parts: Column | str) -> Column:
    """The first of at least two parts of a title."""
    return F.when(F.size(_col(parts)) > 1, F.get(_col(parts), F.lit(0)))


def tail_of(parts: Column | str) -> Column:
    """All parts of a title but the first, joined; null without a second."""
    own = _col(parts)
    tail = F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), " ")
    return F.when(F.size(own) > 1, tail)


def title_stem(title: Column | str) -> Column:
    return stem_of(title_parts(title))


def title_tail(title: Column | str) -> Column:
    return tail_of(title_parts(title))


def fanout_verdict(title: Column | str, location: Column | str) -> Column:
    """Whether the varying part of a title names the posting's own place."""
    return verdict_of(place_tokens(F.coalesce(title_tail(title), F.lit(""))), place_tokens(location))


def verdict_of(tail: Column, place: Column) -> Column:
    """The same from the words of the tail and of the place."""
    return (
        F.when(F.size(tail) == 0, "uninformative")
        .when(F.size(place) == 0, "unstated")
        .when(F.arrays_overlap(tail, place), "geographic")
        .otherwise("not_geographic")
    )


def leading_words(pattern: str) -> tuple[str, ...]:
    """Words of letters and digits, one of which every match of a pattern starts with; none if that is not certain."""
    start = re.match(r"\\b(?:\(\?:([^()]*)\)(\??))?", pattern)
    if not start or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ()
    firsts = [start[1].split("|"), [pattern[start.end() :]] if start[2] else []] if start[1] else [[pattern[start.end() :]]]
    found = []
    for text in (t for part in firsts for t in part):
        word = re.match(r"[a-z0-9]*", text)[0]
        found.append(word[:-1] if text[len(word) : len(word) + 1] in ("?", "*", "{") else word)
    return tuple(found) if all(found) else ()


def word_trie(words: Iterable[str]) -> str:
    """A regular expression for the longest of ``words`` at a place, branching letter by letter."""
    branches: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        branches.setdefault(word[:1], []).append(word[1:])
    ends = "" in branches
    rest = [f"{re.escape(first)}{word_trie(tails)}" for first, tails in branches.items() if first]
    if not rest:
        return ""
    inner = rest[0] if len(rest) == 1 and not ends else f"(?:{'|'.join(rest)})"
    return f"{inner}?" if ends else inner


def technologies(text: Column | str, context: Column | str | None = None) -> Column:
    """Labels of the technologies a text mentions, in list order.

    Ambiguous ones count only if ``context`` (a title, say) is technical.  One
    pass over the text finds which patterns' first words occur; only those
    patterns are tried.
    """
    heads = {label: leading_words(pattern) for label, pattern, _ in lex.TECHNOLOGIES}
    trie = rf"\b({word_trie(w for words in heads.values() for w in words)})"

    def plain(c: Column | str) -> Column:
        return ascii_words(F.regexp_replace(F.coalesce(_col(c), F.lit("")), lex.MARKUP, " "))

    def indexed(r: Column) -> Column:
        low = F.lower(r["body"])
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(trie), F.lit(1)))
        return F.struct(
            r["body"].alias("body"),
            r["setting"].alias("setting"),
            F.concat(F.lit(" "), F.array_join(words, " ")).alias("words"),
        )

    def found(r: Column) -> Column:
        technical = r["setting"].rlike(f"(?i){lex.TECH_CONTEXT}")
        labels = []
        for label, pattern, guarded in lex.TECHNOLOGIES:
            flag = "" if label in lex.CASE_SENSITIVE_TECHNOLOGIES else "(?i)"
            hit = r["body"].rlike(f"{flag}{pattern}")
            if heads[label]:
                # A longer word at the same place starts with the one that is asked for.
                occurs = [F.contains(r["words"], F.lit(f" {w}")) for w in heads[label]]
                hit = reduce(lambda x, y: x | y, occurs) & hit
            labels.append(F.when(hit & technical if guarded else hit, F.lit(label)))
        return F.array_compact(F.array(*labels))

    body = plain(text)
    setting = body if context is None else plain(context)
    # Arrays of one: what stands in them is made once, however many patterns read it.
    sides = F.array(F.struct(body.alias("body"), setting.alias("setting")))
    return F.get(F.transform(F.transform(sides, indexed), found), F.lit(0))


def token_from_url(
    url: Column | str,
    case_sensitive: bool = False,
    token_from: str = "path",
    host: str | None = None,
) -> Column:
    """The company token of a board URL, from its path or its subdomain; null if it has none."""
    raw = _col(url)
    if token_from == "subdomain":
        if not host:
            return F.lit(None).cast("string")
        name = F.lower(F.try_parse_url(raw, F.lit("HOST")))
        suffix = f".{host.lower()}"
        label = F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))
        segment = F.when(~label.contains("."), label)
    else:
        parts = F.split(F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), "/")
        segment = F.get(F.filter(parts, lambda p: p != ""), F.lit(0))
    token = F.trim(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))))
    if not case_sensitive:
        token = F.lower(token)
    fine = (
        (F.length(token) <= 100)
        & ~F.lower(token).isin(*lex.NOT_A_TOKEN)
        & token.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9._-]*$")
        & ~token.rlike(r"^\d+$")
    )
    return F.when(fine, token)


def surt_prefix(host: Column | str, subdomain: bool = False) -> Column:
    """``a.b.c`` as the sort key ``c,b,a)/``, or ``c,b,a,`` for all its subdomains."""
    labels = F.reverse(F.split(F.lower(_col(host)), r"\."))
    return F.concat(F.array_join(labels, ","), F.lit("," if subdomain else ")/"))


def without_suffixes(token: Column | str) -> Column:
    """Letters and digits only, without trailing digits and corporate endings, repeatedly.

    An ending goes only if three characters stay before it.  The endings are
    read from the back, in one pass over the reversed token; possessive, as no
    step is ever taken back.
    """
    bare = F.regexp_replace(F.lower(_col(token)), "[^a-z0-9]", "")
    endings = "|".join(re.escape(suffix[::-1]) for suffix in lex.TOKEN_SUFFIXES)
    return F.reverse(F.regexp_replace(F.reverse(bare), f"^(?:[0-9]++|(?:{endings})(?=.{{3}}))++", ""))


def free_occurrence(token: Column, key: str, blockers) -> Column:
    """Whether ``key`` occurs outside every occurrence of a blocker that holds it."""
    if not any(key in b for b in blockers):
        return token.contains(key)
    barred = [
        rf"(?!(?<=\Q{b[:i]}\E)\Q{b[i:]}\E)" for b in blockers for i in range(len(b)) if b.startswith(key, i)
    ]
    return token.rlike(rf"{''.join(barred)}\Q{key}\E")


def classify_token(token: Column | str, keys=lex.TOKEN_KEYS) -> Column:
    """struct(family, key, mode) of the first industry key that fires; nulls if none."""
    kind = "struct<family:string,key:string,mode:string>"

    def first(r: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None).cast(kind))
        for family, key, mode, blockers in keys:
            hit = r["stripped"].endswith(key) if mode == "end" else free_occurrence(r["low"], key, blockers)
            found = found.when(
                hit, F.struct(F.lit(family).alias("family"), F.lit(key).alias("key"), F.lit(mode).alias("mode"))
            )
        return found.otherwise(F.lit(None).cast(kind))

    # An array of one: both texts are made once, however many keys read them.
    sides = F.array(F.struct(F.lower(_col(token)).alias("low"), without_suffixes(token).alias("stripped")))
    return F.get(F.transform(sides, first), F.lit(0))


def title_needle(key: str) -> str:
    """What is looked for in a padded title: with a space inside, the key with its marks as spaces."""
    return re.sub("[^a-z0-9]+", " ", key) if " " in key else key.strip()


def classify_title(title: Column | str, families=lex.TITLE_FAMILIES) -> Column:
    """The first family with a key inside the padded normalised title, else ``other``.

    One alternation for each block keeps the expression small however many keys.
    """
    padded = padded_title(title)
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, keys in families:
        found = found.when(padded.rlike(_block_pattern(keys)), F.lit(family))
    return found.otherwise(F.lit("other"))


def _block_pattern(keys) -> str:
    return "|".join(rf"\Q{title_needle(k)}\E" for k in keys)


def title_key(title: Column | str, families=lex.TITLE_FAMILIES) -> Column:
    """struct(family, key, weak): the first key that fires, weak if it is a single word.

    An alternation finds the block; only that block's keys are then gone
    through, from a literal table.
    """
    padded = padded_title(title)
    block = F.when(F.lit(False), F.lit(0))
    facts = []
    for number, (family, keys) in enumerate(families):
        block = block.when(padded.rlike(_block_pattern(keys)), number)
        facts.append(
            [
                {"family": family, "key": k, "weak": " " not in k.strip(), "needle": title_needle(k)}
                for k in keys
            ]
        )
    facts.append([{"family": "other", "key": None, "weak": False, "needle": ""}])
    # A foldable expression: the optimizer makes one literal of it.
    fields = "family:string,key:string,weak:boolean,needle:string"
    table = F.from_json(F.lit(json.dumps(facts)), f"array<array<struct<{fields}>>>")
    own = F.get(table, block.otherwise(len(families)))
    first = F.get(F.filter(own, lambda r: F.contains(padded, r["needle"])), F.lit(0))
    return first.dropFields("needle")


def round_half_up(value: Column, digits: int) -> Column:
    """Rounds as floor(x * 10^n + 0.5) / 10^n does, in doubles."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson's interval for k of n, [0, 1] for n = 0."""
    n_ = F.nullif(n, F.lit(0)).cast("double")
    p = k / n_
    scale = 1 + z * z / n_
    centre = (p + z * z / (2 * n_)) / scale
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(
        F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(1.0)).alias("high")
    )


def escape_html(text: Column | str) -> Column:
    """The five characters that mean something in HTML as entities; null as the empty string."""
    out = F.coalesce(_col(text), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out
