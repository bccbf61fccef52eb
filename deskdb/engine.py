"""The engine: connect to a database, run statements of the dialect, get DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from deskdb import metadata
from deskdb.catalog import Database
from deskdb.errors import AnalysisError, NotConnected
from deskdb.operators.select import select
from deskdb.sql import nodes as N
from deskdb.sql.parser import parse
from deskdb.sql.tokens import strip_escapes


def connection(text: str) -> dict[str, str]:
    """A connection string's parts, keys in lower case: ``DBQ=path;...`` or ``DSN=name;...``; braces may hold a semicolon."""
    return {m[1].strip().lower(): (m[2] if m[2] is not None else m[3]).strip() for m in re.finditer(r"([^=;]+)=(?:\{([^}]*)\}|([^;]*))", text)}


class Engine:
    """``sources``: names for CONNECT TO and DSN= (a folder, or a Database). ``folders``: where relative paths are looked for."""

    def __init__(self, spark: SparkSession, database: Database | str | None = None, collation: str | None = None, sources: dict[str, Database | str] | None = None, folders: list[str] | None = None) -> None:
        self.spark, self.collation = spark, collation
        self.sources, self.folders = dict(sources or {}), list(folders or [])
        self.db: Database | None = Database(spark, database) if isinstance(database, str) else database

    def connect(self, to: str) -> "Engine":
        """By a name of ``sources``, a path, or a connection string (DBQ= a path, DSN= a name, whose Database= may give a path)."""
        if re.match(r"\s*(DSN|DBQ)\s*=", to, re.I):
            parts = connection(to)
            to = parts.get("dbq") or parts.get("database") or parts.get("dsn") or ""
        found = self.sources.get(to)
        if isinstance(found, Database):
            self.db = found
            return self
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = found or to
        for path in [at, *(f"{f.rstrip('/')}/{at}" for f in self.folders)]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(conf).exists(where):
                self.db = Database(self.spark, path)
                return self
        raise AnalysisError(f"no database at {at}")

    def disconnect(self) -> None:
        if self.db is None:
            raise NotConnected("not connected")
        self.db = None

    @property
    def database(self) -> Database:
        if self.db is None:
            raise NotConnected("not connected")
        return self.db

    def execute(self, sql: str) -> DataFrame:
        """A statement's result, lazily. CONNECT and DISCONNECT give an empty one. ``{d '...'}`` braces are taken off first."""
        node = parse(strip_escapes(sql))
        if isinstance(node, N.Select):
            return select(self.database, node, self.collation)
        if isinstance(node, N.ListTables):
            return metadata.list_tables(self.database)
        if isinstance(node, N.Describe):
            return metadata.describe_table(self.database, node.table)
        if isinstance(node, N.Connect):
            self.connect(node.path)
        else:
            self.disconnect()
        return self.spark.createDataFrame([], "result string")

    def explain(self, sql: str) -> str:
        """The plan that a statement runs by."""
        df = self.execute(sql)
        return df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def cursor(self) -> "Cursor":
        return Cursor(self)


class Cursor:
    """Prepare, execute and fetch, in the manner of DB-API."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.sql, self.result, self._rows = engine, "", None, iter(())

    def prepare(self, sql: str) -> "Cursor":
        self.sql = sql
        return self

    def execute(self, sql: str | None = None) -> "Cursor":
        self.result = self.engine.execute(sql or self.sql)
        self._rows: Iterator[Row] = self.result.toLocalIterator()
        return self

    @property
    def description(self) -> list[tuple]:
        """name, type name, display width, stored size, precision, scale, nullable of each column."""
        return metadata.describe_result(self.result.schema) if self.result is not None else []

    def fetchone(self) -> Row | None:
        return next(self._rows, None)

    def fetchmany(self, n: int = 1) -> list[Row]:
        return [r for _, r in zip(range(n), self._rows)]

    def fetchall(self) -> list[Row]:
        return list(self._rows)

    def get(self, row: Row, column: int, to: str):
        """Column ``column`` (from 1) of a row, converted as a client asks: see metadata.convert."""
        return metadata.convert(row[column - 1], to)

    def rewind(self) -> None:
        if self.result is not None:
            self._rows = self.result.toLocalIterator()

    def close(self) -> None:
        self.result, self._rows = None, iter(())

    def __iter__(self) -> Iterator[Row]:
        return self._rows
