"""Column types: the desktop database's names, Spark's types, sizes and display widths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Kind:
    """A column type. size: bytes stored, 0 where it is not fixed."""

    name: str
    code: int
    size: int
    width: int
    quoted: bool = False
    binary: bool = False


# Type codes, names and display widths of the file format.
BOOLEAN = Kind("Boolean", 0x01, 0, 5)
BYTE = Kind("Byte", 0x02, 1, 4)
INTEGER = Kind("Integer", 0x03, 2, 6)
LONG = Kind("Long Integer", 0x04, 4, 11)
CURRENCY = Kind("Currency", 0x05, 8, 21)
SINGLE = Kind("Single", 0x06, 4, 10)
DOUBLE = Kind("Double", 0x07, 8, 10)
DATETIME = Kind("DateTime", 0x08, 8, 20, quoted=True)
BINARY = Kind("Binary", 0x09, 255, 255, quoted=True, binary=True)
TEXT = Kind("Text", 0x0A, 510, 255, quoted=True)
OLE = Kind("OLE", 0x0B, 0, 64, quoted=True, binary=True)
MEMO = Kind("Memo/Hyperlink", 0x0C, 0, 64, quoted=True)
REPID = Kind("Replication ID", 0x0F, 16, 40, quoted=True, binary=True)
NUMERIC = Kind("Numeric", 0x10, 17, 20)
COMPLEX = Kind("Complex", 0x12, 4, 11)
KINDS = {k.code: k for k in (BOOLEAN, BYTE, INTEGER, LONG, CURRENCY, SINGLE, DOUBLE, DATETIME, BINARY, TEXT, OLE, MEMO, REPID, NUMERIC, COMPLEX)}


def unknown(code: int) -> Kind:
    return Kind(f"Unknown_{code:04x}", code, 0, 64)


def spark_type(kind: Kind, precision: int = 18, scale: int = 0, short_date: bool = False) -> T.DataType:
    """The Spark type in which a column of ``kind`` is read."""
    if kind == DATETIME:
        return T.DateType() if short_date else T.TimestampNTZType()
    if kind == NUMERIC:
        return T.DecimalType(min(38, max(1, precision)), min(38, max(0, scale)))
    return {
        BOOLEAN: T.BooleanType(), BYTE: T.ShortType(), INTEGER: T.ShortType(), LONG: T.IntegerType(), COMPLEX: T.IntegerType(), CURRENCY: T.DecimalType(19, 4),
        SINGLE: T.FloatType(), DOUBLE: T.DoubleType(), BINARY: T.BinaryType(), OLE: T.BinaryType(),
    }.get(kind, T.StringType())


def kind_of(field: T.StructField) -> Kind:
    """The reported type of a Spark column. Its metadata may say otherwise: ``kind`` (a type's name), or ``size``."""
    said = (field.metadata or {}).get("kind")
    if said:
        return next((k for k in KINDS.values() if k.name.lower() == str(said).lower()), unknown(0))
    t = field.dataType
    if isinstance(t, T.DecimalType):
        return CURRENCY if (t.precision, t.scale) == (19, 4) else NUMERIC
    found = {
        T.BooleanType: BOOLEAN, T.ByteType: BYTE, T.ShortType: INTEGER, T.IntegerType: LONG, T.LongType: NUMERIC, T.FloatType: SINGLE, T.DoubleType: DOUBLE,
        T.TimestampNTZType: DATETIME, T.TimestampType: DATETIME, T.DateType: DATETIME, T.BinaryType: BINARY, T.StringType: TEXT,
    }
    return found.get(type(t), Kind("Unknown", 0, 0, 64))


def size_of(field: T.StructField) -> int:
    said = (field.metadata or {}).get("size")
    return int(said) if said is not None else kind_of(field).size


def precision_of(field: T.StructField) -> tuple[int, int]:
    t = field.dataType
    if isinstance(t, T.DecimalType):
        return t.precision, t.scale
    return (19, 0) if isinstance(t, T.LongType) else (0, 0)


def is_short_date(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.DateType) or (field.metadata or {}).get("Format") == "Short Date"


def width_of(field: T.StructField) -> int:
    """Characters that a value takes when printed in boxes."""
    kind = kind_of(field)
    return max(1, size_of(field) // 2) if kind == TEXT else kind.width
