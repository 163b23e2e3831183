"""One role posted over many places: fan-out stems, a gazetteer, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.text import (
    normal_title,
    place_tokens,
    round_half_up,
    stem_of,
    tail_of,
    title_parts,
    verdict_of,
)

# Fixed values.
LEAST_TITLES = 5
LEAST_BOARDS = 3


def split_titles(rows: DataFrame, board: str = "board") -> DataFrame:
    """Distinct (board, title, location) of ``rows`` with n, norm, stem, tail and place_words.

    Boards post a title many times, so rows are counted before patterns run;
    each pattern then runs once for a distinct title.  What reads the result
    more than once should write it down first (``staged``).
    """
    single = rows.groupBy(board, "title", "location").agg(F.count("*").alias("n"))
    parts = single.withColumns({"parts": title_parts("title"), "norm": normal_title("title")})
    return parts.select(
        board,
        "n",
        "norm",
        stem_of("parts").alias("stem"),
        F.coalesce(tail_of("parts"), F.lit("")).alias("tail"),
        place_tokens("location").alias("place_words"),
    )


def fanout_stems(split: DataFrame, board: str = "board", least: int = LEAST_TITLES) -> DataFrame:
    """Stems that at least ``least`` distinct titles of a board share, from ``split_titles``."""
    return (
        split.where(F.col("stem") != F.col("norm"))
        .groupBy(board, "stem", "norm")
        .agg(F.sum("n").alias("n"))
        .groupBy(board, "stem")
        .agg(F.count("*").alias("titles"), F.sum("n").alias("postings"))
        .where(F.col("titles") >= least)
    )


def fanout_boards(split: DataFrame, board: str = "board") -> DataFrame:
    return fanout_stems(split, board).groupBy(board).agg(
        F.count("*").alias("stems"), F.sum("postings").alias("fanout_postings")
    )


def token_support(split: DataFrame, board: str = "board") -> DataFrame:
    """token, in_places and in_titles: on how many boards a word occurs in either."""
    sides = F.array(
        F.struct(F.lit("place").alias("kind"), F.col("place_words").alias("words")),
        F.struct(F.lit("title").alias("kind"), place_tokens("tail").alias("words")),
    )
    tagged = split.select(board, F.explode(sides).alias("s"))
    tagged = tagged.select(board, F.col("s.kind").alias("kind"), F.explode("s.words").alias("token"))
    return tagged.distinct().groupBy("token").agg(
        F.count_if(F.col("kind") == "place").alias("in_places"),
        F.count_if(F.col("kind") == "title").alias("in_titles"),
    )


def gazetteer(support: DataFrame, least: int = LEAST_BOARDS, tight: bool = True) -> DataFrame:
    """Words that are places: on enough boards and, if ``tight``, more there than in titles."""
    known = F.col("in_places") >= least
    if tight:
        known &= F.col("in_places") >= F.col("in_titles")
    return support.where(known).select("token", "in_places", "in_titles")


def rejected_tokens(support: DataFrame, least: int = LEAST_BOARDS) -> DataFrame:
    """Words that the title side keeps out of the gazetteer."""
    out = (F.col("in_places") >= least) & (F.col("in_places") < F.col("in_titles"))
    return support.where(out)


def gazetteer_comparison(support: DataFrame, least: int = LEAST_BOARDS, shown: int = 20) -> DataFrame:
    """One row: words that count as places by place alone and with the title side heard.

    recall is the part of the loose list that the tight one keeps; disputed
    are kept words that titles name too, rejected those that titles name more
    often, both with the most titles first.
    """
    loose = F.col("in_places") >= least
    kept = loose & (F.col("in_places") >= F.col("in_titles"))
    facts = {
        "disputed": support.where(kept & (F.col("in_titles") > 0)),
        "rejected": support.where(loose & ~kept),
    }
    totals = support.agg(
        F.count_if(loose).alias("loose"),
        F.count_if(kept).alias("tight"),
        F.count_if(kept & (F.col("in_titles") > 0)).alias("disputed"),
        F.count_if(loose & ~kept).alias("rejected"),
        round_half_up(F.try_divide(F.count_if(kept), F.count_if(loose)), 4).alias("recall"),
    )
    for name, rows in facts.items():
        # A report of ``shown`` words, joined to a one-row frame.
        top = rows.orderBy(F.desc("in_titles"), F.desc("in_places"), "token").limit(shown)
        ranked = F.sort_array(
            F.collect_list(F.struct(-F.col("in_titles"), -F.col("in_places"), "token"))
        )
        listed = top.agg(F.transform(ranked, lambda r: r["token"]).alias(f"{name}_words"))
        totals = totals.join(listed, F.lit(True))
    return totals


def verified_rows(split: DataFrame, places: DataFrame, board: str = "board") -> DataFrame:
    """Fan-out titles with n, their verdict and whether the title names a known place.

    Whether it does depends on the title's tail alone, so distinct tails meet
    the gazetteer, which may be of any size.
    """
    stems = fanout_stems(split, board).select(F.col(board).alias("_b"), F.col("stem").alias("_s"))
    named = split.select(
        board, "n", "stem", "tail", verdict_of(place_tokens("tail"), F.col("place_words")).alias("verdict")
    )
    kept = named.join(stems, (F.col(board) == F.col("_b")) & (F.col("stem") == F.col("_s")))
    kept = kept.drop("_b", "_s")
    tails = kept.select("tail").distinct()
    words = tails.select("tail", F.explode(place_tokens("tail")).alias("token"))
    hits = words.join(places.select("token"), "token", "left_semi").select("tail").distinct()
    hits = hits.withColumn("known_place", F.lit(True))
    joined = kept.join(hits, "tail", "left")
    return joined.withColumn("known_place", F.coalesce("known_place", F.lit(False))).drop("tail")


def gazetteer_hit(title, places: list[str]):
    """The first word of a title's tail that is a place, in the title's own order; null if none."""
    words = F.split(normal_title(F.coalesce(tail_of(title_parts(title)), F.lit(""))), " ")
    known = F.array(*map(F.lit, places)) if places else F.array().cast("array<string>")
    return F.get(F.filter(words, lambda w: F.array_contains(known, w)), F.lit(0))


def first_known_place(split: DataFrame, places: DataFrame, board: str = "board") -> DataFrame:
    """tail and hit: of each distinct tail the first word that the gazetteer holds."""
    words = split.select("tail").distinct().select(
        "tail", F.posexplode(F.split("tail", " ")).alias("at", "token")
    )
    found = words.join(places.select("token"), "token", "left_semi")
    return found.groupBy("tail").agg(F.min_by("token", "at").alias("hit"))


def stem_verdicts(verified: DataFrame, board: str = "board") -> DataFrame:
    """Per fan-out stem: postings, verdict counts and what the testifying half says."""
    verdict, known = F.col("verdict"), F.col("known_place")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = verified.groupBy(board, "stem").agg(
        F.sum("n").alias("postings"),
        *[
            total(verdict == v).alias(v)
            for v in ("geographic", "not_geographic", "unstated", "uninformative")
        ],
        *[
            total((verdict == v) & known).alias(f"known_{v}")
            for v in ("geographic", "not_geographic", "unstated")
        ],
    )
    spoke = F.col("geographic") + F.col("not_geographic")
    says = (
        F.when(spoke == 0, "undecidable")
        .when(2 * F.col("geographic") >= spoke, "geographic")
        .otherwise("not_geographic")
    )
    return counts.withColumn("stem_verdict", says)


def fanout_bounds(stems: DataFrame, board: str = "board") -> DataFrame:
    """Per board: verdict counts and the bounds on postings that repeat one role.

    The lower bound has the rows whose own place settles it; the upper adds
    rows that say otherwise or nothing but name a known place.
    """
    sums = [
        "postings",
        "geographic",
        "not_geographic",
        "unstated",
        "uninformative",
        "known_geographic",
        "known_not_geographic",
        "known_unstated",
    ]
    says = F.col("stem_verdict")
    totals = stems.groupBy(board).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[
            F.count_if(says == v).alias(f"stems_{v}")
            for v in ("geographic", "not_geographic", "undecidable")
        ],
    )
    upper = F.col("geographic") + F.col("known_not_geographic") + F.col("known_unstated")
    return totals.withColumns({"lower": F.col("geographic"), "upper": upper})
