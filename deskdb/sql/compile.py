"""From predicates to Spark columns, by the types of the schema."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from deskdb.errors import AnalysisError
from deskdb.sql import nodes as N

_OPS = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
SERIAL_DAY_ZERO = "timestamp_ntz'1899-12-30 00:00:00'"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(schema: T.StructType, name: str) -> T.StructField:
    """A field by name; capitals don't matter, an exact match goes first."""
    found = [f for f in schema if f.name == name] or [f for f in schema if f.name.lower() == name.lower()]
    if not found:
        raise AnalysisError(f"Column {name} not found")
    return found[0]


def moment(value: object) -> Column:
    """A date literal: whole numbers are seconds since 1970 (UTC), fractions are days since 1899-12-30, rounded to a millionth of a day."""
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp_ntz") if value.tzinfo else F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")
    if isinstance(value, int):
        return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {value})")
    micros = round(round(value, 6) * 86_400_000_000)
    return F.expr(f"{SERIAL_DAY_ZERO} + make_dt_interval(0, 0, 0, cast({micros} as decimal(20, 0)) / 1000000)")


def literal(field: T.StructField, value: object, op: str) -> Column:
    """``value`` as a column's type compares with it."""
    t = field.dataType
    wrong = AnalysisError(f"{field.name} ({t.simpleString()}) can't be compared with {value!r}")
    if isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        if isinstance(value, (int, float, datetime)):
            return moment(value)
        raise wrong
    if isinstance(t, T.StringType):
        if isinstance(value, str):
            return F.lit(value)
        raise wrong
    if isinstance(t, T.BinaryType):
        if isinstance(value, str):
            return F.lit(value).cast("binary")
        raise wrong
    if isinstance(value, datetime) or isinstance(value, str) or isinstance(value, bool):
        raise wrong
    if isinstance(t, T.BooleanType):
        return F.lit(bool(value))
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit(int(value))
    if isinstance(t, T.DecimalType):
        return F.lit(Decimal(str(value)))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.lit(float(value))
    raise wrong


def predicate(node: object, schema: T.StructType, collation: str | None = None) -> Column:
    """Three-valued logic throughout. ``collation`` orders and equates texts; the default is by bytes."""
    again = lambda n: predicate(n, schema, collation)
    if isinstance(node, N.And):
        return again(node.left) & again(node.right)
    if isinstance(node, N.Or):
        return again(node.left) | again(node.right)
    if isinstance(node, N.Not):
        return ~again(node.of)
    if isinstance(node, N.Literal):
        return F.lit(bool(node.value))
    if isinstance(node, N.IsNull):
        col = F.col(quote(resolve(schema, node.name.text).name))
        return col.isNotNull() if node.negated else col.isNull()
    if not isinstance(node, N.Compare):
        raise AnalysisError(f"not a predicate: {node}")
    field = resolve(schema, node.left.text)
    col, value = F.col(quote(field.name)), node.right.value
    if node.op in ("LIKE", "ILIKE"):
        if not isinstance(field.dataType, T.StringType) or not isinstance(value, str):
            raise AnalysisError(f"{node.op} takes a text column and a text")
        pattern = value.replace("\\", "\\\\")  # the dialect has no escape
        return col.like(pattern) if node.op == "LIKE" else col.ilike(pattern)
    right = literal(field, value, node.op)
    if isinstance(field.dataType, T.StringType) and collation:
        col, right = F.collate(col, collation), F.collate(right, collation)
    if isinstance(field.dataType, T.BooleanType) and node.op not in ("=", "<>"):
        col, right = col.cast("int"), F.lit(value)
    return _OPS[node.op](col, right)
