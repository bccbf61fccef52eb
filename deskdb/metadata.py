"""What is known about a database and its results, as DataFrames."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, functions as F, types as T

from deskdb import types as K
from deskdb.catalog import Database
from deskdb.errors import DeskError

# Client type codes, and the names that clients see.
CLIENT_CODES = {K.BOOLEAN: -7, K.BYTE: -6, K.INTEGER: 5, K.LONG: 4, K.CURRENCY: 3, K.SINGLE: 6, K.DOUBLE: 8, K.DATETIME: 93, K.TEXT: 12, K.MEMO: 12, K.OLE: -4, K.BINARY: -2, K.REPID: 1, K.NUMERIC: 2, K.COMPLEX: 4}
CLIENT_NAMES = {K.BOOLEAN: "BOOL", K.BYTE: "BYTE", K.INTEGER: "INT", K.LONG: "LONGINT", K.CURRENCY: "MONEY", K.SINGLE: "FLOAT", K.DOUBLE: "DOUBLE", K.DATETIME: "DATETIME", K.TEXT: "TEXT", K.MEMO: "MEMO", K.OLE: "OLE", K.BINARY: "BINARY", K.REPID: "REPID", K.NUMERIC: "NUMERIC", K.COMPLEX: "COMPLEX"}
DATE_CODE = 91

# What the type table says; name, code, size, counts up by itself, SQL code where it is another.
TYPE_TABLE = [
    ("text", 12, 255, 0, 12),
    ("memo", 12, 4096, 0, 12),
    ("ole", 12, 16384, 0, 12),
    ("text", 1, 255, 0, 1),
    ("numeric", 2, 255, 0, 2),
    ("numeric", 3, 255, 0, 3),
    ("long integer", 4, 4, 1, 4),
    ("integer", 5, 4, 1, 5),
    ("integer", 5, 4, 1, 5),
    ("single", 7, 4, 1, 7),
    ("double", 8, 8, 1, 6),
    ("datetime", 9, 8, 1, 9),
]


def list_tables(db: Database) -> DataFrame:
    """One column, Tables: the user's tables in the catalog's order."""
    if db.has_side("objects"):
        return db.objects().filter("type = 1 and not is_system").orderBy("id").select(F.col("name").alias("Tables"))
    return db.spark.createDataFrame([(n,) for n in db.names()], "Tables string")


def list_objects(db: Database, kind: str = "table", system: bool = False) -> DataFrame:
    """name, type, object_type of the objects of one kind (an object type's name, ``any`` or ``all``); ``systable`` and ``system`` let system tables in."""
    found = db.objects()
    kind = kind.lower()
    if kind == "systable":
        found = found.filter("is_system")
    elif kind not in ("any", "all"):
        found = found.filter(F.col("object_type") == kind)
    if not system and kind != "systable":
        found = found.filter("not is_system")
    return found.orderBy("id").select("name", "type", "object_type")


def count(db: Database, table: str) -> int:
    return db.table(table).count()


def version(db: Database) -> str:
    """The kind of store behind a database."""
    return "PARQUET" if db.path else "MEMORY"


def describe_table(db: Database, table: str) -> DataFrame:
    """Column Name, Type, Size of each column, as texts."""
    rows = [(f.name, K.kind_of(f).name, str(K.size_of(f))) for f in db.schema(table)]
    return db.spark.createDataFrame(rows, "`Column Name` string, Type string, Size string")


def describe_result(schema: T.StructType) -> list[tuple]:
    return [(f.name, K.kind_of(f).name, K.width_of(f), K.size_of(f), *K.precision_of(f), f.nullable) for f in schema]


def properties(db: Database, table: str) -> DataFrame:
    """column, name, value: the properties of a table (column null) and of its columns."""
    own = db.find(table)
    return db.side("properties").filter(F.col("table") == own).select("column", "name", "value")


def indexes(db: Database, table: str) -> DataFrame:
    return db.side("indexes").filter(F.col("table") == db.find(table))


def relationships(db: Database, table: str | None = None) -> DataFrame:
    found = db.side("relationships")
    return found if table is None else found.filter(F.col("szObject") == db.find(table))


def stored_queries(db: Database) -> DataFrame:
    """Names of the stored queries."""
    return db.objects().filter("type = 5").orderBy("id").select("name")


def query_texts(rows: DataFrame) -> DataFrame:
    """object_id and sql of each stored query, put together from its parts (columns as in catalog.QUERIES).

    Parts of attribute 3 hold what stands before the columns (flags 0x30 TOP, with 0x20 PERCENT; 0x8 DISTINCTROW; 0x2 DISTINCT), 5 a table, 6 a column,
    8 the condition, 11 the sort key (name1 D: descending; the first counts). Joins (7) are not part of the text.
    """
    parts = rows.select("object_id", "attribute", F.coalesce("order", F.lit(b"")).alias("o"), F.coalesce("expression", F.lit("")).alias("e"), F.coalesce("flag", F.lit(0)).alias("f"), F.coalesce("name1", F.lit("")).alias("n"))
    has = lambda bits: F.col("f").bitwiseAND(F.lit(bits)) != 0
    before = (
        F.when(has(0x30), F.concat(F.lit(" TOP "), F.col("n"), F.when(has(0x20), F.lit(" PERCENT")).otherwise(F.lit(""))))
        .when(has(0x8), F.lit(" DISTINCTROW")).when(has(0x2), F.lit(" DISTINCT")).otherwise(F.lit(""))
    )
    listed = lambda attribute, text: F.array_sort(F.collect_list(F.when(F.col("attribute") == attribute, F.struct("o", text.alias("t")))))
    grouped = parts.groupBy("object_id").agg(
        listed(3, before).alias("p"), listed(5, F.concat(F.lit("["), F.col("n"), F.lit("]"))).alias("t"), listed(6, F.col("e")).alias("c"), listed(8, F.col("e")).alias("w"),
        listed(11, F.concat(F.lit("ORDER BY "), F.col("e"), F.when(F.col("n") == "D", F.lit(" DESCENDING")).otherwise(F.lit("")))).alias("s"),
    )
    joined = lambda c: F.array_join(F.col(f"{c}.t"), ",")
    last = lambda c: F.coalesce(F.element_at(F.col(f"{c}.t"), F.lit(-1)), F.lit(""))
    one = lambda c, pick: F.when(F.size(c) > 0, pick(c)).otherwise(F.lit(""))
    where = F.when((F.size("w") > 0) & (one("w", last) != ""), F.concat(F.lit(" WHERE "), one("w", last))).otherwise(F.lit(""))
    first = lambda c: F.element_at(F.col(f"{c}.t"), F.lit(1))
    return grouped.select("object_id", F.concat(F.lit("SELECT"), one("p", last), F.lit(" "), joined("c"), F.lit(" FROM "), joined("t"), where, F.lit(" "), one("s", first)).alias("sql"))


def stored_query(db: Database, name: str) -> str:
    """The text of one stored query, by its name."""
    found = query_texts(db.side("queries")).join(db.objects().filter((F.col("type") == 5) & (F.col("name") == name)).select(F.col("id").alias("object_id")), "object_id").select("sql").head()
    if found is None:
        raise DeskError(f"no such query: {name}")
    return found["sql"]


def client_tables(db: Database) -> DataFrame:
    """TABLE_CAT, TABLE_SCHEM, TABLE_NAME, TABLE_TYPE, REMARKS of tables, system tables and stored queries (as VIEW)."""
    kind = F.when((F.col("type") == 1) & F.col("is_system"), "SYSTEM TABLE").when(F.col("type") == 1, "TABLE").when(F.col("type") == 5, "VIEW")
    none = F.lit(None).cast("string")
    return db.objects().withColumn("kind", kind).filter("kind is not null").select(none.alias("TABLE_CAT"), none.alias("TABLE_SCHEM"), F.col("name").alias("TABLE_NAME"), F.col("kind").alias("TABLE_TYPE"), none.alias("REMARKS"))


def client_code(field: T.StructField) -> int:
    kind = K.kind_of(field)
    return DATE_CODE if kind == K.DATETIME and K.is_short_date(field) else CLIENT_CODES.get(kind, 12)


def client_columns(db: Database, table: str) -> DataFrame:
    """The 18 columns that clients expect about each column of a table."""
    rows = []
    for k, f in enumerate(db.schema(table)):
        code = client_code(f)
        rows.append((None, None, db.find(table), f.name, code, CLIENT_NAMES.get(K.kind_of(f), "UNKNOWN"), None, None, None, None, 0, None, None, code, None, None, k + 1, None))
    schema = (
        "TABLE_CAT string, TABLE_SCHEM string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE int, TYPE_NAME string, COLUMN_SIZE int, BUFFER_LENGTH int, DECIMAL_DIGITS int, NUM_PREC_RADIX int, "
        "NULLABLE int, REMARKS string, COLUMN_DEF string, SQL_DATA_TYPE int, SQL_DATETIME_SUB int, CHAR_OCTET_LENGTH int, ORDINAL_POSITION int, IS_NULLABLE string"
    )
    return db.spark.createDataFrame(rows, schema)


def client_types(db: Database) -> DataFrame:
    """The 19 columns of the type table, a row for each type."""
    rows = [(name, code, size, None, None, None, 1, 1, 1, None, 0, auto, None, 0, size, sql, None, None, None) for name, code, size, auto, sql in TYPE_TABLE]
    schema = (
        "TYPE_NAME string, DATA_TYPE int, COLUMN_SIZE int, LITERAL_PREFIX string, LITERAL_SUFFIX string, CREATE_PARAMS string, NULLABLE int, CASE_SENSITIVE int, SEARCHABLE int, UNSIGNED_ATTRIBUTE int, "
        "FIXED_PREC_SCALE int, AUTO_UNIQUE_VALUE int, LOCAL_TYPE_NAME string, MINIMUM_SCALE int, MAXIMUM_SCALE int, SQL_DATA_TYPE int, SQL_DATETIME_SUB int, NUM_PREC_RADIX int, INTERVAL_PRECISION int"
    )
    return db.spark.createDataFrame(rows, schema)


_RANGES = {"tinyint": (-128, 127), "utinyint": (0, 255), "smallint": (-32768, 32767), "usmallint": (0, 65535), "integer": (-(2**31), 2**31 - 1), "uinteger": (0, 2**32 - 1), "bigint": (-(2**63), 2**63 - 1), "ubigint": (0, 2**64 - 1)}


class OutOfRange(DeskError):
    """SQLSTATE 22003."""


class NotImplementedType(DeskError):
    """SQLSTATE HYC00."""


def convert(value: object, to: str):
    """A value as a client asks for it: an integer type's name (range-checked), bit, float, double, char, binary, date, time, timestamp, numeric. Null stays null."""
    to = to.lower()
    if value is None:
        return None
    if to in _RANGES:
        if isinstance(value, (datetime, date, bytes, bytearray)):
            raise NotImplementedType(f"{type(value).__name__} as {to}")
        try:
            n = math.trunc(Decimal(value) if isinstance(value, str) else value)
        except (ArithmeticError, ValueError) as e:
            raise NotImplementedType(f"{value!r} as {to}") from e
        low, high = _RANGES[to]
        if not low <= n <= high:
            raise OutOfRange(f"{n} as {to}")
        return n
    if to == "bit":
        n = convert(value, "bigint")
        if n not in (0, 1):
            raise OutOfRange(f"{n} as bit")
        return n
    if to in ("float", "double"):
        if isinstance(value, (datetime, date, bytes, bytearray)):
            raise NotImplementedType(f"{type(value).__name__} as {to}")
        return float(value)
    if to == "numeric":
        return Decimal(str(value))
    if to == "binary":
        return value if isinstance(value, (bytes, bytearray)) else str(value).encode()
    if to == "char":
        from deskdb.functions.values import python_text

        return python_text(value)
    if to in ("date", "time", "timestamp") and isinstance(value, (datetime, date)):
        at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return {"date": at.date(), "time": at.time().replace(microsecond=0), "timestamp": at}[to]
    raise NotImplementedType(f"{type(value).__name__} as {to}")


def chunks(value: str | bytes | None, size: int):
    """A long text or binary in pieces, as (piece, more to come); null is one piece of None."""
    if value is None or not value:
        yield value, False
        return
    for lo in range(0, len(value), size):
        yield value[lo : lo + size], lo + size < len(value)
