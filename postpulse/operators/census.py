"""Title families over boards: weighted census, board priors, key audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.functions import lexicons as lex
from postpulse.functions.text import title_key, wilson
from postpulse.operators.ranking import with_place
from postpulse.operators.staging import staged

# Fixed values.
NO_ROLE = ("suspect_recruitment_ad", "volunteer_unpaid", "generic", "other", "non_english")
JUNK = ("suspect_recruitment_ad", "volunteer_unpaid")
SUPPORTS = (1, 2, 3, 5, 8, 10)
CONFIDENCES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
PRIOR_SUPPORT, PRIOR_CONFIDENCE, JUNK_MOST = 5, 0.7, 0.10
CHOICE_ACCURACY, CHOICE_SUPPORT, CHOICE_WEAK = 0.90, 5, 500
AGREEMENT_LEAST, AUDITED_LEAST = 0.70, 5


def is_role(family: Column) -> Column:
    return ~family.isin(*NO_ROLE)


def classified(titles: DataFrame, title: str = "title", families=lex.TITLE_FAMILIES) -> DataFrame:
    """``titles`` with family, key and weak of each title; null titles are ``other``.

    Boards post the same titles over and over, so each distinct one is
    classified once and the answers are joined back.
    """
    facts = titles.select(F.col(title).alias("_title")).distinct()
    facts = facts.withColumn("_fact", title_key("_title", families))
    # Written down: else a filter on the family would be inferred for every row
    # of ``titles`` through the join, and classify each of them again.
    facts = staged(facts)
    joined = titles.join(facts, F.col(title).eqNullSafe(F.col("_title")))
    names = ("family", "key", "weak")
    return joined.withColumns({n: F.col(f"_fact.{n}") for n in names}).drop("_title", "_fact")


def head_and_tail(boards: DataFrame, head: int, step: int, size: str = "postings") -> DataFrame:
    """The ``head`` largest boards, every ``step``-th of the rest, and the tail's weight.

    Weight is tail boards over sampled tail boards, 1 for the head.
    """
    total = boards.count()
    rest = F.col("place") - head
    stratum = F.when(rest < 0, "head").when(rest % step == 0, "tail")
    tail = max(total - head, 0)
    tail_weight = tail / -(-tail // step) if tail else None
    weight = F.when(stratum == "head", 1.0).otherwise(F.lit(tail_weight).cast("double"))
    rows = with_place(boards, size).withColumns({"stratum": stratum, "weight": weight})
    return rows.where(F.col("stratum").isNotNull()).drop("place")


def weighted_census(titles: DataFrame) -> DataFrame:
    """Family counts of head boards plus weighted tail counts, and shares.

    ``titles`` has family, stratum and weight for each title.
    """
    head = F.count_if(F.col("stratum") == "head")
    tail = F.sum(F.when(F.col("stratum") == "tail", F.col("weight")))
    counts = titles.groupBy("family").agg(
        head.alias("head"), F.coalesce(tail, F.lit(0.0)).alias("tail_weighted")
    )
    estimate = F.col("head") + F.col("tail_weighted")
    share = estimate / F.sum(estimate).over(Window.partitionBy())
    return counts.withColumns({"estimate": estimate, "share": share})


def category_share(titles: DataFrame, family: str, board: str = "board") -> DataFrame:
    counts = titles.groupBy(board).agg(
        F.count("*").alias("titles_read"), F.count_if(F.col("family") == family).alias("in_family")
    )
    return counts.withColumn("share", F.col("in_family") / F.col("titles_read"))


def board_prior(titles: DataFrame, board: str = "board") -> DataFrame:
    """Each board's modal role family: support, confidence, and the share of junk titles.

    Ties go to the lowest name.  Support counts role titles; confidence is the
    mode's part of them.
    """
    family = F.col("family")
    counts = titles.groupBy(board, "family").agg(F.count("*").alias("n"))
    role = is_role(family)
    top = F.min(F.when(role, F.struct(-F.col("n"), "family")))["family"]
    most = F.max(F.when(role, F.col("n")))
    support = F.coalesce(F.sum(F.when(role, F.col("n"))), F.lit(0))
    junk = F.coalesce(F.sum(F.when(family.isin(*JUNK), F.col("n"))), F.lit(0))
    return counts.groupBy(board).agg(
        F.sum("n").alias("titles_read"),
        top.alias("inferred_family"),
        support.alias("support"),
        (most / support).alias("confidence"),
        (junk / F.sum("n")).alias("junk_share"),
    )


def applied_prior(titles: DataFrame, prior: DataFrame, board: str = "board") -> DataFrame:
    """Generic titles on clean boards whose prior is strong enough take its family."""
    fit = (F.col("support") >= PRIOR_SUPPORT) & (F.col("confidence") >= PRIOR_CONFIDENCE)
    fit &= F.col("junk_share") < JUNK_MOST
    strong = prior.where(fit).select(F.col(board).alias("_b"), F.col("inferred_family").alias("prior"))
    joined = titles.join(strong, F.col(board) == F.col("_b"), "left").drop("_b")
    generic = F.col("family") == "generic"
    assigned = F.when(generic, F.col("prior"))
    return joined.withColumns(
        {"assigned": assigned, "resolved": F.coalesce(assigned, F.col("family"))}
    ).drop("prior")


def leave_one_out(
    titles: DataFrame,
    supports=SUPPORTS,
    confidences=CONFIDENCES,
    board: str = "board",
) -> DataFrame:
    """Accuracy of predicting a role title from the rest of its board, over a grid.

    What a title's rest predicts depends only on its board and its own family,
    so titles are counted by (board, family, weak) first and the grid is laid
    over those counts: boards x families squared, never titles x grid.
    """
    roles = titles.where(is_role(F.col("family")))
    counts = roles.groupBy(board, "family").agg(
        F.count("*").alias("n"), F.count_if("weak").alias("n_weak")
    )
    others = counts.select(F.col(board).alias("_b"), F.col("family").alias("other"), F.col("n").alias("m"))
    pairs = counts.join(others, F.col(board) == F.col("_b"))
    left = F.col("m") - (F.col("other") == F.col("family")).cast("long")
    rest = pairs.withColumn("left", left).groupBy(board, "family", "n", "n_weak")
    rest = rest.agg(
        F.sum("left").alias("support"),
        F.min(F.when(F.col("left") > 0, F.struct((-F.col("left")).alias("neg"), "other"))).alias("top"),
    )
    rest = rest.select(
        "family",
        "n",
        "n_weak",
        "support",
        F.col("top.other").alias("predicted"),
        (-F.col("top.neg") / F.col("support")).alias("confidence"),
    )
    grid = F.array(
        *[
            F.struct(F.lit(s).alias("least_support"), F.lit(c).alias("least_confidence"))
            for s in supports
            for c in confidences
        ]
    )
    laid = rest.withColumn("g", F.explode(grid)).select("*", "g.*")
    fires = (F.col("support") >= F.col("least_support")) & (
        F.col("confidence") >= F.col("least_confidence")
    )
    right = fires & (F.col("predicted") == F.col("family"))
    total = lambda c, n: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    sums = laid.groupBy("least_support", "least_confidence").agg(
        F.sum("n").alias("titles"),
        total(fires, "n").alias("predicted"),
        total(right, "n").alias("correct"),
        total(fires, "n_weak").alias("predicted_weak"),
        total(right, "n_weak").alias("correct_weak"),
    )
    return sums.withColumns(
        {
            "coverage": F.col("predicted") / F.col("titles"),
            "accuracy": F.try_divide(F.col("correct"), F.col("predicted")),
            "weak_accuracy": F.try_divide(F.col("correct_weak"), F.col("predicted_weak")),
        }
    )


def chosen_point(
    grid: DataFrame, least_weak: int = CHOICE_WEAK, accuracy: float = CHOICE_ACCURACY
) -> DataFrame:
    """The grid point with most coverage among those accurate enough; ties: least support."""
    fit = (F.col("weak_accuracy") >= accuracy) & (F.col("least_support") >= CHOICE_SUPPORT)
    fit &= F.col("predicted_weak") >= least_weak
    order = [F.desc("coverage"), "least_support", "least_confidence"]
    return grid.where(fit).orderBy(*order).limit(1)


def key_audit(hits: DataFrame) -> DataFrame:
    """Per key: boards it hit, fired on and was checked on, agreement and verdict.

    ``hits`` has key, blocked, fired and agrees (null if unchecked).
    """
    checked = F.col("fired") & F.col("agrees").isNotNull()
    counts = hits.groupBy("key").agg(
        F.count("*").alias("raw_hits"),
        F.count_if("blocked").alias("blocked_hits"),
        F.count_if("fired").alias("fired"),
        F.count_if(checked).alias("audited"),
        F.count_if(checked & F.col("agrees")).alias("agreed"),
    )
    rate = F.try_divide(F.col("agreed"), F.col("audited"))
    interval = wilson(F.col("agreed"), F.col("audited"))
    keep = (F.col("audited") >= AUDITED_LEAST) & (rate >= AGREEMENT_LEAST)
    basis = F.when(F.col("audited") == F.col("fired"), "census").otherwise("sample")
    return counts.select(
        "*",
        rate.alias("agreement"),
        interval["low"].alias("low"),
        interval["high"].alias("high"),
        basis.alias("basis"),
        F.when(F.coalesce(keep, F.lit(False)), "keep").otherwise("drop").alias("verdict"),
    )


def board_family(titles: DataFrame, board: str = "board") -> DataFrame:
    """junk_board, no_resolved_titles, or the modal role family of each board."""
    prior = board_prior(titles, board)
    name = (
        F.when(F.col("junk_share") >= JUNK_MOST, "junk_board")
        .when(F.col("inferred_family").isNull(), "no_resolved_titles")
        .otherwise(F.col("inferred_family"))
    )
    return prior.select(board, name.alias("title_family"))


def industry_fill(tokens: DataFrame, families: DataFrame, board: str = "board") -> DataFrame:
    """The token's industry beside the titles' family: agrees, disagrees or unchecked."""
    joined = tokens.join(families.withColumnRenamed(board, "_b"), F.col(board) == F.col("_b"), "left")
    judged = F.col("title_family").isin("junk_board", "no_resolved_titles")
    unknown = F.col("title_family").isNull() | judged
    checked = (
        F.when(F.col("industry_family").isNull() | unknown, "unchecked")
        .when(F.col("industry_family") == F.col("title_family"), "agrees")
        .otherwise("disagrees")
    )
    return joined.withColumn("checked", checked).drop("_b")


def lexicon_audit(titles: DataFrame, examples: int = 3) -> DataFrame:
    """Per firing key: its hits and its first few titles in order."""
    ranked = titles.where(F.col("key").isNotNull()).withColumn(
        "place", F.row_number().over(Window.partitionBy("family", "key").orderBy("title"))
    )
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= examples, F.col("title"))))
    return ranked.groupBy("family", "key").agg(F.count("*").alias("hits"), shown.alias("examples"))
