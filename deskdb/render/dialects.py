"""SQL dialects: their type names, capabilities, statements and quoting. More can be registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from deskdb import types as K
from deskdb.errors import AnalysisError
from deskdb.functions import dates

DROP, NOT_NULL, NOT_EMPTY, COMMENTS, INDEXES, RELATIONS, DEFAULTS, BULK = "drop", "not null", "not empty", "comments", "indexes", "relations", "defaults", "bulk insert"


@dataclass(frozen=True)
class TypeName:
    """takes: "" no length, "L" a length, "C" a length in characters, "PS" precision and scale."""

    name: str
    takes: str = ""


def quoted(text: str, quote: str, escape: str | None = None) -> str:
    """``text`` in quotes: the quote is escaped (doubled), control characters are \\ooo."""
    return quote + "".join(f"\\{ord(c):03o}" if ord(c) < 32 else (escape or quote) + c if c == quote else c for c in text) + quote


def bracketed(schema: str | None, name: str) -> str:
    return f"[{schema}_{name}]" if schema else f"[{name}]"


def double_quoted(schema: str | None, name: str) -> str:
    return ".".join(quoted(x, '"') for x in (schema, name) if x)


def back_quoted(schema: str | None, name: str) -> str:
    return quoted(f"{schema}_{name}" if schema else name, "`")


@dataclass(frozen=True)
class Dialect:
    name: str
    types: dict[K.Kind, TypeName]
    can: frozenset[str]
    short_now: str
    long_now: str
    quote: Callable[[str | None, str], str]
    short_date: TypeName | None = None
    serial: TypeName | None = None
    charset: str = "-- That file uses encoding {}"
    create: str = "CREATE TABLE {}\n"
    drop: str = "DROP TABLE {};"
    check: str | None = None
    column_comment: str | None = None
    table_comment: str | None = None
    lower: bool = False
    iso_dates: bool = False
    namespaced_keys: bool = True
    formats: tuple[str, str] = field(default=(dates.LONG, dates.SHORT))

    def identifier(self, name: str, schema: str | None = None) -> str:
        text = self.quote(schema, name)
        return text.lower() if self.lower else text

    def type_of(self, kind: K.Kind, short: bool = False, auto: bool = False) -> TypeName:
        if auto and self.serial:
            return self.serial
        if short and self.short_date:
            return self.short_date
        return self.types.get(kind, TypeName(kind.name))


def _types(boolean, byte, integer, long, currency, single, double, datetime, binary, text, ole, memo, repid, numeric) -> dict[K.Kind, TypeName]:
    order = (K.BOOLEAN, K.BYTE, K.INTEGER, K.LONG, K.CURRENCY, K.SINGLE, K.DOUBLE, K.DATETIME, K.BINARY, K.TEXT, K.OLE, K.MEMO, K.REPID, K.NUMERIC)
    given = (boolean, byte, integer, long, currency, single, double, datetime, binary, text, ole, memo, repid, numeric)
    made = {k: TypeName(*x) if isinstance(x, tuple) else TypeName(x) for k, x in zip(order, given)}
    return {**made, K.COMPLEX: made[K.LONG]}


# The dialects' type names, by the order of _types, and their statements.
_COMMENT_COLUMN, _COMMENT_TABLE, _CHECK = "COMMENT ON COLUMN {}.{} IS {};", "COMMENT ON TABLE {} IS {};", "ALTER TABLE {} ADD CHECK ({} <>'');"
DIALECTS: dict[str, Dialect] = {}


def register_dialect(dialect: Dialect) -> None:
    DIALECTS[dialect.name] = dialect


def dialect(name: str) -> Dialect:
    if name not in DIALECTS:
        raise AnalysisError(f"unknown dialect {name}")
    return DIALECTS[name]


register_dialect(
    Dialect(
        "access",
        _types("Boolean", "Byte", "Integer", "Long Integer", "Currency", "Single", "Double", "DateTime", "Binary", ("Text", "C"), ("OLE", "L"), ("Memo/Hyperlink", "L"), "Replication ID", ("Numeric", "PS")),
        frozenset({DROP, NOT_NULL, DEFAULTS}), "Date()", "Date()", bracketed,
    )
)
register_dialect(
    Dialect(
        "sybase",
        _types("bit", ("char", "L"), "smallint", "int", "money", "real", "float", "smalldatetime", ("varbinary", "L"), ("nvarchar", "C"), "varbinary(max)", "nvarchar(max)", "Sybase_Replication ID", ("numeric", "PS")),
        frozenset({DROP, NOT_NULL, NOT_EMPTY, COMMENTS, DEFAULTS}), "getdate()", "getdate()", double_quoted,
        short_date=TypeName("DATE"), check=_CHECK, column_comment=_COMMENT_COLUMN, table_comment=_COMMENT_TABLE,
    )
)
register_dialect(
    Dialect(
        "oracle",
        _types("NUMBER(1)", "NUMBER(3)", "NUMBER(5)", "NUMBER(11)", "NUMBER(15,2)", "FLOAT", "FLOAT", "TIMESTAMP", "BINARY", ("VARCHAR2", "C"), "BLOB", "CLOB", ("NUMBER", "PS"), ("NUMBER", "PS")),
        frozenset({DROP, NOT_NULL, COMMENTS, INDEXES, RELATIONS, DEFAULTS}), "current_date", "sysdate", double_quoted,
        short_date=TypeName("DATE"), column_comment=_COMMENT_COLUMN, table_comment=_COMMENT_TABLE,
    )
)
register_dialect(
    Dialect(
        "postgres",
        _types("BOOLEAN", "SMALLINT", "INTEGER", "INTEGER", "NUMERIC(15,2)", "REAL", "DOUBLE PRECISION", "TIMESTAMP WITHOUT TIME ZONE", "BYTEA", ("VARCHAR", "C"), "BYTEA", "TEXT", "UUID", ("NUMERIC", "PS")),
        frozenset({DROP, NOT_NULL, NOT_EMPTY, COMMENTS, INDEXES, RELATIONS, DEFAULTS, BULK}), "current_date", "now()", double_quoted,
        short_date=TypeName("DATE"), serial=TypeName("SERIAL"), charset="SET client_encoding = '{}';", create="CREATE TABLE IF NOT EXISTS {}\n", drop="DROP TABLE IF EXISTS {};",
        check=_CHECK, column_comment=_COMMENT_COLUMN, table_comment=_COMMENT_TABLE, lower=True, iso_dates=True, namespaced_keys=False,
    )
)
register_dialect(
    Dialect(
        "mysql",
        _types("boolean", "tinyint", "smallint", "int", "float", "float", "double", "datetime", "blob", ("varchar", "C"), "blob", "text", "char(38)", ("numeric", "PS")),
        frozenset({DROP, NOT_NULL, NOT_EMPTY, INDEXES, RELATIONS, DEFAULTS, BULK}), "current_date", "now()", back_quoted,
        short_date=TypeName("date"), serial=TypeName("int not null auto_increment unique"), drop="DROP TABLE IF EXISTS {};", check=_CHECK, iso_dates=True,
    )
)
register_dialect(
    Dialect(
        "sqlite",
        _types("INTEGER", "INTEGER", "INTEGER", "INTEGER", "REAL", "REAL", "REAL", "DateTime", "BLOB", "varchar", "BLOB", "TEXT", "INTEGER", "INTEGER"),
        frozenset({DROP, NOT_NULL, INDEXES, DEFAULTS, BULK}), "date('now')", "date('now')", back_quoted, drop="DROP TABLE IF EXISTS {};", iso_dates=True,
    )
)
