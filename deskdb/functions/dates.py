"""Date serials and date formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deskdb.errors import AnalysisError

#: Days from 1899-12-30 to 1970-01-01.
EPOCH_SERIAL = 25569
LONG, SHORT = "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"

# Directives of strftime, as Spark's date patterns say them.
_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "x": "yyyy-MM-dd", "X": "HH:mm:ss"}


def java_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; %x and %X are ISO. Unknown directives are errors."""
    out, at = [], 0
    while at < len(strftime):
        c = strftime[at]
        if c == "%":
            d = strftime[at + 1 : at + 2]
            if d == "%":
                out.append("'%'")
            elif d in _JAVA:
                out.append(_JAVA[d])
            elif d in ("n", "t"):
                out.append({"n": "\n", "t": "\t"}[d])
            else:
                raise AnalysisError(f"unknown directive %{d}")
            at += 2
        else:
            out.append("''" if c == "'" else f"'{c}'" if c.isalpha() or c in "[]{}#" else c)
            at += 1
    return "".join(out)


def format_date(col: Column, strftime: str) -> Column:
    return F.date_format(col, java_pattern(strftime))


def serial(col: Column) -> Column:
    """A timestamp as days since 1899-12-30 with the part of the day, by whole seconds."""
    return F.unix_timestamp(col.cast("timestamp")) / 86400 + EPOCH_SERIAL


def from_serial(col: Column) -> Column:
    """Days since 1899-12-30 as a timestamp without zone, rounded to seconds; below 0 or above a million, null."""
    seconds = F.round((col - EPOCH_SERIAL) * 86400).cast("long")
    return F.when((col >= 0) & (col <= 1_000_000), F.timestamp_seconds(seconds).cast("timestamp_ntz"))
