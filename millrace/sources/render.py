"""Query results as a text grid."""

from __future__ import annotations

from pyspark.sql import DataFrame


def text_of(value: object) -> str:
    """A value as text: booleans by name, doubles with six significant digits."""
    if value is None:
        return "NULL"
    return f"{value:g}" if isinstance(value, float) else str(value)


def grid(names: list[str], rows: list[tuple]) -> str:
    """The grid of a result: a rule, the names, a rule, the rows, a rule, and how many they are."""
    if not rows:
        return "Empty set\n"
    cells = [[text_of(v) for v in row] for row in rows]
    widths = [2 + max(len(name), *(len(row[i]) for row in cells)) for i, name in enumerate(names)]
    rule = "+" + "".join("-" * w + "+" for w in widths)
    lines = ["|" + "".join(f" {cell}".ljust(w) + "|" for cell, w in zip(row, widths, strict=True)) for row in (names, *cells)]
    return "\n".join([rule, lines[0], rule, *lines[1:], rule, f"{len(rows)} rows in set", ""])


def render(df: DataFrame) -> str:
    """A result that fits on the driver, as a grid."""
    return grid(df.columns, [tuple(r) for r in df.collect()])
