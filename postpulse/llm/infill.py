"""Operator 11: fill-in-the-middle arrangement, in Spark SQL functions alone.

A text is cut into units (code points, or whatever ``Infill.unit`` matches),
two cuts drawn from a hash of the document's id part it into prefix, middle
and suffix, and the parts are written down behind sentinels with the middle
last, so that a model reading from left to right learns to fill a gap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import picked

#: Every match is one code point, line ends included.
CODE_POINTS = "(?s)."
#: Every match is a word with the white space behind it, or leading white space.
WORDS = r"\S+\s*|\s+"


@dataclass(frozen=True)
class Infill:
    """Sentinels, shares (in hundredths) and the unit of the cuts.

    ``unit`` is a regular expression whose matches make up the whole text.
    ``salt`` stands before the id in what is hashed: another salt, other cuts.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    arranged: int = 90
    suffix_first: int = 20
    salt: str = "1:"
    unit: str = CODE_POINTS

    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self) -> None:
        firsts = {s[:1] for s in self.sentinels()}
        if "" in firsts or any(x in s[1:] for s in self.sentinels() for x in firsts):
            raise ValueError("a sentinel's first character may stand at sentinels' starts only")
        if len({*self.sentinels()}) < 3:
            raise ValueError("sentinels must differ")


def draw(digest: Column, k: int) -> Column:
    """The k-th (from 0) eight hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def joined(units: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(units, start + 1, count), "")


def arrange(
    df: DataFrame, spec: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units and output for each row.

    ``n`` counts the text's units.  ``form`` is plain (output: the text), psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle); in plain rows the
    unit counts are null.  Texts that hold a sentinel stay plain, so every
    output can be restored.  A null text is the empty text and plain; a null
    id draws as an empty one; repeated rows get the same output each; other
    columns are ignored; an empty table gives no rows.  Nothing is shuffled: a
    row needs its own text's units, some 60 bytes for each while it lasts.
    """
    rows = picked(df, doc_id=id_col, text=text_col).select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(spec.salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        .alias("digest"),
    )
    units = rows.select("*", F.regexp_extract_all("text", F.lit(spec.unit), F.lit(0)).alias("units"))
    h1, h2, h3, h4 = (draw(F.col("digest"), k) for k in range(4))
    cuts = units.select(
        "doc_id",
        "text",
        "units",
        F.size("units").cast("long").alias("n"),
        F.least(h1 % (F.size("units") + 1), h2 % (F.size("units") + 1)).alias("low"),
        F.greatest(h1 % (F.size("units") + 1), h2 % (F.size("units") + 1)).alias("high"),
        F.when(_stays_plain(spec) | (h3 % 100 >= spec.arranged), "plain")
        .when(h4 % 100 < spec.suffix_first, "spm")
        .otherwise("psm")
        .alias("form"),
    )
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    prefix = joined(F.col("units"), F.lit(0), low.cast("int"))
    middle = joined(F.col("units"), low.cast("int"), (high - low).cast("int"))
    suffix = joined(F.col("units"), high.cast("int"), (n - high).cast("int"))
    p, s, m = (F.lit(x) for x in spec.sentinels())
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    return cuts.select(
        "doc_id",
        "n",
        "form",
        F.when(F.col("form") != "plain", low).alias("prefix_units"),
        F.when(F.col("form") != "plain", high - low).alias("middle_units"),
        output.alias("output"),
    )


def _stays_plain(spec: Infill) -> Column:
    found = F.col("text") == ""
    for sentinel in spec.sentinels():
        found |= F.contains(F.col("text"), F.lit(sentinel))
    return found


def restored(output: Column, form: Column, spec: Infill = Infill()) -> Column:
    """The text that ``arrange`` was given, from its output and form."""
    p, s, m = spec.sentinels()
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    first_p = F.substring_index(F.substring_index(head, s, 1), p, -1)
    first_s = F.substring_index(F.substring_index(head, p, 1), s, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(first_p, middle, F.substring_index(head, s, -1)))
        .otherwise(F.concat(F.substring_index(head, p, -1), middle, first_s))
    )
