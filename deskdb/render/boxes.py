"""Results as boxes of text, and the footer that says how many rows there were. For results that a person reads: rows come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from deskdb.functions.values import Style, python_text
from deskdb.types import width_of


def retrieved(n: int) -> str:
    return "No Rows retrieved" if n == 0 else "1 Row retrieved" if n == 1 else f"{n} Rows retrieved"


def boxes(df: DataFrame, header: bool = True, footer: bool = True, style: Style = Style()) -> Iterator[str]:
    """Lines, made as rows arrive. A column is as wide as its type prints, or as its name."""
    widths = [max(len(f.name), width_of(f)) for f in df.schema]
    rule = "+" + "".join("-" * w + "+" for w in widths)
    line = lambda cells: "|" + "".join(c.ljust(w) + "|" for c, w in zip(cells, widths))
    yield rule
    if header:
        yield line(df.columns)
        yield rule
    n = 0
    for row in df.toLocalIterator():
        n += 1
        yield line([python_text(v, style) or "" for v in row])
    yield rule
    if footer:
        yield retrieved(n)


def plain(df: DataFrame, delimiter: str = "\t", header: bool = True, footer: bool = True, style: Style = Style()) -> Iterator[str]:
    """Lines of delimited values, without quotes."""
    if header:
        yield delimiter.join(df.columns)
    n = 0
    for row in df.toLocalIterator():
        n += 1
        yield delimiter.join(python_text(v, style) or "" for v in row)
    if footer:
        yield retrieved(n)
