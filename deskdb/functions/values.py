"""How a value of each type is written as text."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from deskdb import types as K
from deskdb.errors import AnalysisError
from deskdb.functions import dates
from deskdb.sql.compile import quote

BINARY_MODES = ("raw", "strip", "octal", "hex")


@dataclass(frozen=True)
class Style:
    """datetime, date: strftime formats. words: FALSE and TRUE instead of 0 and 1. binary: one of BINARY_MODES. braces: GUIDs as {8-4-4-16}."""

    datetime: str = dates.LONG
    date: str = dates.SHORT
    words: bool = False
    binary: str = "raw"
    braces: bool = False


def _each(x: pa.Array, digits: int) -> pa.Array:
    """C's %g with ``digits`` significant digits; a value that comes often is written once."""
    coded = x.dictionary_encode()
    return pa.array([f"{v:.{digits}g}" for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


_double_text = F.arrow_udf(T.StringType())(lambda x: _each(x, 16))
_single_text = F.arrow_udf(T.StringType())(lambda x: _each(x, 8))


def _number_text(col: Column, below: float, rest) -> Column:
    """Whole numbers that are written in full are so in the JVM; Python gets the others, and nulls in place of these."""
    whole = (F.abs(col) >= 1) & (F.abs(col) < below) & (F.floor(col) == col)
    return F.coalesce(F.when(whole, col.cast("long").cast("string")), rest(F.when(~whole, col)))


def double_text(col: Column | str) -> Column:
    """16 significant digits, without trailing zeros, as C's %g. Neither printf nor cast of the JVM writes so."""
    return _number_text(F.col(col) if isinstance(col, str) else col, 1e15, _double_text)


def single_text(col: Column | str) -> Column:
    """8 significant digits, without trailing zeros."""
    return _number_text(F.col(col) if isinstance(col, str) else col, 1e8, _single_text)


def braced(text: Column) -> Column:
    """A GUID's text, 8-4-4-4-12, as {8-4-4-16}; other texts as they are."""
    parts = r"^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4})-([0-9A-Fa-f]{12})$"
    return F.when(F.regexp_like(text, F.lit(parts)), F.concat(F.lit("{"), F.regexp_replace(text, parts, "$1$2"), F.lit("}"))).otherwise(text)


def guid(hexed: Column, braces: bool) -> Column:
    """32 hex digits of a stored GUID (first three groups little-endian) as text."""
    byte = lambda k: F.substring(hexed, 2 * k + 1, 2)
    a, b, c = F.concat(*map(byte, (3, 2, 1, 0))), F.concat(byte(5), byte(4)), F.concat(byte(7), byte(6))
    d, e = F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)
    dash = F.lit("-")
    return F.concat(F.lit("{"), a, dash, b, dash, c, dash, d, e, F.lit("}")) if braces else F.concat(a, dash, b, dash, c, dash, d, dash, e)


def octal(col: Column) -> Column:
    """Every byte as \\ooo."""
    n = F.length(col)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.conv(F.hex(F.substring(col, i, F.lit(1))), 16, 8), 3, "0"))
    return F.when(n > 0, F.concat(F.lit("\\"), F.array_join(digits, "\\"))).otherwise(F.lit(""))


def binary_text(col: Column, mode: str) -> Column:
    if mode not in BINARY_MODES:
        raise AnalysisError(f"unknown binary mode {mode}")
    if mode == "strip":
        return F.when(col.isNotNull(), F.lit(""))
    if mode == "hex":
        return F.hex(col)
    return octal(col) if mode == "octal" else F.decode(col, "ISO-8859-1")


def rendered(field: T.StructField, style: Style = Style()) -> Column:
    """A column as text; null stays null. Raw binaries are one character a byte."""
    col, t, kind = F.col(quote(field.name)), field.dataType, K.kind_of(field)
    if isinstance(t, T.BooleanType):
        no, yes = ("FALSE", "TRUE") if style.words else ("0", "1")
        return F.when(F.coalesce(col, F.lit(False)), yes).otherwise(no)  # never null
    if isinstance(t, T.DoubleType):
        return double_text(col)
    if isinstance(t, T.FloatType):
        return single_text(col)
    if isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return dates.format_date(col, style.date if K.is_short_date(field) else style.datetime)
    if isinstance(t, T.BinaryType):
        return guid(F.hex(col), style.braces) if kind == K.REPID else binary_text(col, style.binary)
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    if kind == K.REPID and style.braces:
        return braced(col.cast("string"))
    return col.cast("string")


def python_text(value: object, style: Style = Style()) -> str | None:
    """The same for one value on the driver."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("TRUE" if value else "FALSE") if style.words else str(int(value))
    if isinstance(value, float):
        return f"{value:.16g}"
    if isinstance(value, datetime):
        return value.strftime(style.datetime)
    if isinstance(value, date):
        return value.strftime(style.date)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("latin-1")
    return str(value)
