"""Operator 13: conversations as training texts, in DataFrame functions alone.

A turn's content is an array of typed parts.  A visitor for each type writes
a part down: text with its control strings escaped, media as a placeholder.
What a placeholder stands for (kind, reference, number of model tokens) goes
to the conversation's attachments, in the placeholders' order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import picked

#: One part: what it is, its text (of media: the description), address and size.
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
#: Media in Markdown; the address may state a size: ``#w=640&h=480``, ``#t=12.5``, ``#pages=3``.
ENDINGS = {
    "image": "png|jpe?g|gif|webp",
    "audio": "mp3|wav|flac|ogg",
    "document": "pdf|docx?|pptx?",
}
MEDIA = rf"!\[([^\[\]\n]*)\]\(([^()\s#]+\.(?:{'|'.join(ENDINGS.values())})(?:#[^()\s]*)?)\)"


@dataclass(frozen=True)
class Template:
    """Marks around a turn, placeholders of media, and further reserved strings.

    A turn is ``opens`` role ``between`` content ``closes``.
    """

    opens: str = "[INST]"
    between: str = "[/INST]"
    closes: str = "</s>"
    image: str = "[IMAGE]"
    audio: str = "[AUDIO]"
    document: str = "[DOCUMENT]"
    reserved: tuple[str, ...] = ("<s>",)

    def media(self) -> dict[str, str]:
        return {"image": self.image, "audio": self.audio, "document": self.document}

    def controls(self) -> tuple[str, ...]:
        return (self.opens, self.between, self.closes, *self.media().values(), *self.reserved)

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls()}
        if "" in firsts or any(x in c[1:] for c in self.controls() for x in {*firsts, "\\"}):
            raise ValueError("controls must differ from each other's insides and hold no backslash")
        if len({*self.controls()}) < len(self.controls()):
            raise ValueError("each control string may be given once")

    def _places(self, slash: str) -> str:
        """Behind a control's first character, any backslashes and the rest following."""
        rests: dict[str, list[str]] = {}
        for c in self.controls():
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        return "|".join(
            rf"(?<={re.escape(first)}){slash}(?=\\*(?:{'|'.join(rest)}))" for first, rest in rests.items()
        )

    def escaped(self, text: Column) -> Column:
        r"""Every control string gets a backslash behind its first character.

        Those that have some already get one more, so nothing is ambiguous and
        no control string is left: ``</s>`` is ``<\/s>``, ``<\/s>`` is ``<\\/s>``.
        """
        return F.regexp_replace(text, F.lit(self._places("")), F.lit(r"\\"))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._places(r"\\")), F.lit(""))


@dataclass(frozen=True)
class Sizes:
    """Model tokens that media take; the last three stand for unstated sizes."""

    patch: int = 28
    tokens_a_second: float = 25.0
    tokens_a_page: int = 1_000
    image: int = 256
    audio: int = 750
    document: int = 1_000


#: What visitors give for the parts of a turn.
SEEN = "array<struct<written:string,kind:string,ref:string,source:string,tokens:bigint>>"

Visitor = Callable[[Column, Template, Sizes], Column]


def _visited(written: Column, kind: Column, source: Column, ref: Column, tokens: Column) -> Column:
    """What every visitor gives; ``kind`` is null for text, which has no attachment."""
    return F.struct(
        written.alias("written"),
        kind.cast("string").alias("kind"),
        ref.cast("string").alias("ref"),
        source.cast("string").alias("source"),
        tokens.cast("long").alias("tokens"),
    )


def visit_text(part: Column, template: Template, sizes: Sizes) -> Column:
    none = F.lit(None)
    return _visited(template.escaped(_text(part["text"])), none, none, none, none)


def _medium(part: Column, kind: str, template: Template, tokens: Column) -> Column:
    ref = _text(part["ref"])
    source = F.concat(F.lit("!["), _text(part["text"]), F.lit("]("), ref, F.lit(")"))
    return _visited(F.lit(template.media()[kind]), F.lit(kind), source, ref, tokens)


def visit_image(part: Column, template: Template, sizes: Sizes) -> Column:
    across, down = (F.ceil(part[side] / sizes.patch) for side in ("width", "height"))
    return _medium(part, "image", template, F.coalesce(across * down, F.lit(sizes.image)))


def visit_audio(part: Column, template: Template, sizes: Sizes) -> Column:
    tokens = F.ceil(part["seconds"] * sizes.tokens_a_second)
    return _medium(part, "audio", template, F.coalesce(tokens, F.lit(sizes.audio)))


def visit_document(part: Column, template: Template, sizes: Sizes) -> Column:
    tokens = part["pages"].cast("long") * sizes.tokens_a_page
    return _medium(part, "document", template, F.coalesce(tokens, F.lit(sizes.document)))


VISITORS: dict[str, Visitor] = {
    "image": visit_image,
    "audio": visit_audio,
    "document": visit_document,
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def visited(part: Column, template: Template, sizes: Sizes) -> Column:
    """The visitor of the part's type; parts of other types, null ones too, are text."""
    return reduce(
        lambda rest, kind: F.when(part["type"] == kind, VISITORS[kind](part, template, sizes)).otherwise(rest),
        VISITORS,
        visit_text(part, template, sizes),
    )


def parts_of(text: Column) -> Column:
    """A text as parts: Markdown media become parts of their own, the rest is text."""

    def part(kind: Column, text: Column, ref: Column, **sizes: Column) -> Column:
        none = F.lit(None)
        names = {"type": kind, "text": text, "ref": ref, **sizes}
        fields = [f.split() for f in PART.split(", ")]
        return F.struct(*[names.get(n, none).cast(t).alias(n) for n, t in fields])

    def medium(link: Column) -> Column:
        ref = F.regexp_extract(link, MEDIA, 2)

        def size(name: str) -> Column:
            found = F.regexp_extract(ref, rf"#(?:.*&)?{name}=([0-9]{{1,9}}(?:\.[0-9]{{1,9}})?)(?:&|$)", 1)
            return F.when(found != "", found.cast("double"))

        kind = reduce(
            lambda rest, k: F.when(F.rlike(ref, F.lit(rf"\.(?:{ENDINGS[k]})(?:#|$)")), k).otherwise(rest),
            ENDINGS,
            F.lit("text"),
        )
        return part(
            kind, F.regexp_extract(link, MEDIA, 1), ref,
            width=size("w"), height=size("h"), seconds=size("t"), pages=size("pages"),
        )

    def alone(content: Column) -> Column:
        return part(F.lit("text"), content, F.lit(None))

    pieces, links = F.split(text, MEDIA, -1), F.regexp_extract_all(text, F.lit(MEDIA), F.lit(0))
    several = F.flatten(
        F.transform(
            pieces,
            lambda piece, k: F.when(F.get(links, k).isNull(), F.array(alone(piece))).otherwise(
                F.array(alone(piece), medium(F.get(links, k)))
            ),
        )
    )
    return F.when(F.contains(text, F.lit("](")), several).otherwise(F.array(alone(_text(text))))


def format_conversations(
    df: DataFrame,
    template: Template = Template(),
    sizes: Sizes = Sizes(),
    learned: str = "assistant",
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns, loss_spans, attachments, media_tokens.

    Content comes from ``parts_col`` (an array of ``PART`` structs) or else
    from ``text_col`` by ``parts_of``.  ``loss_spans`` are (turn, start, end)
    in code points of ``formatted``: the contents of the turns whose role is
    ``learned``, marks left out.  ``turns`` holds each turn's start and which
    attachments are its own; ``attachments`` are (kind, ref, source, tokens)
    in the order of the placeholders and ``media_tokens`` their sum.

    Turns go by number, then role, then content; nulls first, repeated rows
    each for itself.  A null role, text or part is empty; rows of a null id
    are one conversation; other columns are ignored; an empty table gives no
    rows.  Rows are written down before the one shuffle, which deals by
    conversation.  A conversation is one row of the result: its text has to
    fit one, and one task's memory some three times.
    """
    content = F.col("parts") if parts_col else parts_of(F.col("text"))
    columns = {"conv_id": conv_col, "turn": turn_col, "role": role_col}
    rows = picked(df, **columns, **({"parts": parts_col} if parts_col else {"text": text_col}))
    seen = F.transform(content, lambda part: visited(part, template, sizes))
    flat = rows.select(
        "conv_id",
        "turn",
        (_text(F.col("role")) == learned).alias("is_learned"),
        template.escaped(_text(F.col("role"))).alias("role"),
        F.coalesce(seen, F.array().cast(SEEN)).alias("seen"),
    ).select(
        "conv_id",
        "turn",
        "is_learned",
        F.concat(F.lit(template.opens), "role", F.lit(template.between)).alias("mark"),
        F.array_join(F.transform("seen", lambda s: s["written"]), "").alias("content"),
        F.transform(
            F.filter("seen", lambda s: s["kind"].isNotNull()),
            lambda s: F.struct(*[s[n].alias(n) for n in ("kind", "ref", "source", "tokens")]),
        ).alias("media"),
    )
    written = flat.withColumn("chars", F.length("mark") + F.length("content") + len(template.closes))
    order = Window.partitionBy("conv_id").orderBy("turn", "mark", "content", "media")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = written.select(
        "*",
        F.row_number().over(order).alias("no"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"),
        F.coalesce(F.sum(F.size("media")).over(before), F.lit(0)).alias("first"),
    )
    start = F.col("start") + F.length("mark")
    one = F.struct(
        "no",
        F.concat("mark", "content", F.lit(template.closes)).alias("piece"),
        F.struct("start", F.col("first").cast("int").alias("first"), F.size("media").alias("n")).alias("turn"),
        F.when(
            F.col("is_learned"),
            F.struct(
                (F.col("no") - 1).alias("turn"), start.alias("start"), (start + F.length("content")).alias("end")
            ),
        ).alias("span"),
        "media",
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("all", lambda t: t["turn"]).alias("turns"),
        F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("all", lambda t: t["media"])).alias("attachments"),
    ).withColumn(
        "media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with read_turns (role, text) and loss_text, from the formatted text.

    Placeholders become the Markdown of their attachments again; loss_text is
    what stands under the loss spans, in order.  Every turn is cut out once,
    so the work grows with the text.
    """

    def restored(content: Column, media: Column) -> Column:
        places = "|".join(re.escape(p) for p in template.media().values())
        full = F.transform(
            F.split(content, places, -1),
            lambda piece, k: F.concat(piece, _text(template.escaped(F.get(media, k)["source"]))),
        )
        return template.unescaped(F.when(F.size(media) == 0, content).otherwise(F.array_join(full, "")))

    def media_of(turn: Column) -> Column:
        return F.slice(F.col("attachments"), turn["first"] + 1, turn["n"])

    def turn_at(k: Column) -> Column:
        return F.get(F.col("turns"), k.cast("int"))

    def read(piece: Column, k: Column) -> Column:
        mark = F.substring_index(piece, template.between, 1)
        content = F.substring_index(piece, template.between, -1)
        return F.struct(
            template.unescaped(F.substring(mark, F.lit(len(template.opens) + 1), F.length(mark))).alias("role"),
            restored(content, media_of(turn_at(k))).alias("text"),
        )

    def under(span: Column) -> Column:
        turn = turn_at(span["turn"])
        piece = F.get(F.col("pieces"), span["turn"].cast("int"))
        at = (span["start"] - turn["start"] + 1).cast("int")
        return restored(F.substring(piece, at, (span["end"] - span["start"]).cast("int")), media_of(turn))

    pieces = F.split("formatted", re.escape(template.closes), -1)
    cut = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    return cut.withColumns(
        {
            "read_turns": F.transform("pieces", read),
            "loss_text": F.array_join(F.transform("loss_spans", under), ""),
        }
    ).drop("pieces")
