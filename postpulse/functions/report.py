"""Markdown over small frames: the only place that formats numbers as text."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame


def fixed(value: float, digits: int) -> str:
    """The decimal expansion of the double itself, rounded half up."""
    step = Decimal(1).scaleb(-digits)
    return str(Decimal(value).quantize(step, rounding=ROUND_HALF_UP))


def thousands(value: int) -> str:
    return f"{value:,}"


def markdown_table(rows: DataFrame, titles: dict[str, str], limit: int = 100) -> str:
    """At most ``limit`` rows of a ranked frame as a table."""
    lines = [f"| {' | '.join(titles.values())} |", f"|{'---|' * len(titles)}"]
    for row in rows.select(*titles).limit(limit).collect():
        cells = []
        for value in row:
            if value is None:
                cells.append("–")
            elif isinstance(value, bool):
                cells.append("yes" if value else "no")
            elif isinstance(value, int):
                cells.append(thousands(value))
            elif isinstance(value, float):
                cells.append(fixed(value, 2))
            else:
                cells.append(str(value).replace("|", "\\|"))
        lines.append(f"| {' | '.join(cells)} |")
    return "\n".join(lines)


def issue_report(day: str, stats: DataFrame, tables: dict[str, tuple[DataFrame, dict]]) -> str:
    """A whole issue: its totals and its ranked tables."""
    totals = stats.first().asDict()
    parts = [f"# Issue {day}", ""]
    parts += [f"- {name.replace('_', ' ')}: {thousands(value)}" for name, value in totals.items()]
    for title, (rows, columns) in tables.items():
        parts += ["", f"## {title}", "", markdown_table(rows, columns)]
    return "\n".join(parts) + "\n"


_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight")


def count_word(n: int) -> str:
    """Numbers up to eight as words."""
    return _NUMBERS[n] if 0 <= n < len(_NUMBERS) else str(n)


def list_phrase(names: list[str]) -> str:
    """``a, b and c``."""
    return " and ".join(filter(None, [", ".join(names[:-1]), *names[-1:]]))
