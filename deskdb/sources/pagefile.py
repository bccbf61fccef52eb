"""A Spark data source over page files: ``spark.read.format("deskpages").option("table", name).load(path)``.

The driver reads the table's definition and usage map; each task then reads its own run of pages. Paths may be local or URIs that
pyarrow's file systems know. ``database`` gives a whole file as a Database, with its objects, properties, indexes, relationships and queries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from deskdb import types as K
from deskdb.catalog import INDEXES, OBJECTS, PROPERTIES, QUERIES, RELATIONSHIPS, Database
from deskdb.sources.pages import Column, PageError, PageFile, Table

FORMAT = "deskpages"
#: Pages that a task reads.
PAGES_A_TASK = 4096
BATCH_ROWS = 5000


def open_file(path: str) -> PageFile:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    source = store.open_input_file(at)
    return PageFile(lambda offset, n: source.read_at(n, offset), source.size())


def field_of(c: Column, props: dict[str, str] | None = None) -> T.StructField:
    kind = K.KINDS.get(c.code)
    about: dict[str, object] = {"kind": kind.name if kind else f"Unknown_{c.code:04x}", "size": 0 if c.code == K.BOOLEAN.code else c.length, **(props or {})}
    if c.auto:
        about["autonumber"] = "true"
    short = about.get("Format") == "Short Date"
    t = T.BinaryType() if kind is None else K.spark_type(kind, c.precision, c.scale, short)
    return T.StructField(c.name, t, c.code != K.BOOLEAN.code, about)


def schema_of(table: Table, props: dict[str, dict[str, str]] | None = None) -> T.StructType:
    return T.StructType([field_of(c, (props or {}).get(c.name)) for c in table.columns])


def dated(row: dict, schema: T.StructType) -> dict:
    """A row whose short dates are dates."""
    for t in schema:
        if isinstance(t.dataType, T.DateType) and row[t.name] is not None:
            row[t.name] = row[t.name].date()
    return row


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return schema_of(*open_file(self.options["path"]).described(self.options["table"]))

    def reader(self, schema: T.StructType) -> "PageReader":
        return PageReader(self.options["path"], self.options["table"], schema, int(self.options.get("pagespertask", PAGES_A_TASK)))


class Run(InputPartition):
    """Pages, and the table's definition, so that tasks don't read the catalog."""

    def __init__(self, pages: list[int], table: Table) -> None:
        self.pages, self.table = pages, table


class PageReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, size: int) -> None:
        self.path, self.table, self.types, self.size = path, table, schema, max(1, size)

    def partitions(self) -> list[Run]:
        f = open_file(self.path)
        table = f.find(self.table)
        pages = list(f.data_pages(table))
        return [Run(pages[k : k + self.size], table) for k in range(0, len(pages), self.size)] or [Run([], table)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, kinds = open_file(self.path), to_arrow_schema(self.types)
        rows: list[dict] = []
        for row in f.rows(run.table, run.pages):
            rows.append(dated(row, self.types))
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format(FORMAT).option("table", table).option("path", path).load()


def _described(table: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("content").to_pylist():
                yield pa.RecordBatch.from_pydict({"schema": [schema_of(*PageFile.of_bytes(blob).described(table)).json()]})

    return run


def read_bytes(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of each of many small files, of any store that Spark reads: a file is one row of bytes, decoded where it is."""
    files = spark.read.format("binaryFile").load(path).select("content")
    described = files.limit(1).mapInArrow(_described(table), "schema string").head()  # read by a task; the driver gets the schema alone
    if described is None:
        raise PageError(f"no files at {path}")
    schema = T.StructType.fromJson(json.loads(described["schema"]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            for blob in b.column("content").to_pylist():
                own = PageFile.of_bytes(blob)
                rows = [dated(r, schema) for r in own.rows(own.find(table))]
                yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    return files.mapInArrow(decode, schema)


def version(path: str) -> str:
    return open_file(path).version


def database(spark: SparkSession, path: str) -> Database:
    """A page file as a Database. The catalog and its side tables are small and read on the driver; tables are read by tasks."""
    f = open_file(path)
    objects = f.objects()
    tables = [o for o in objects if o["type"] == 1]
    side: dict[str, list[tuple]] = {"objects": [], "indexes": [], "properties": [], "relationships": [], "queries": []}
    made = {}
    for o in objects:
        props = f.properties(o["props"])
        side["objects"].append((int(o["id"]), o["name"], o["type"], o["flags"], props.get("", {})))
        for column, own in props.items():
            side["properties"] += [(o["name"], column or None, k, v) for k, v in own.items()]
    for o in tables:
        t = f.table(int(o["id"]) & 0xFFFFFF)
        names = {c.number: c.name for c in t.columns}
        made[str(o["name"])] = read_table(spark, path, str(o["name"]))
        side["indexes"] += [(o["name"], x.name, x.kind, x.flags, [(names.get(n, ""), d) for n, d in x.keys]) for x in t.indexes]
    low = {str(o["name"]).lower(): o for o in tables}
    if "msysrelationships" in low:
        for r in f.rows(f.find("MSysRelationships")):
            side["relationships"].append(tuple(r.get(k) for k in ("szColumn", "szObject", "szReferencedColumn", "szReferencedObject", "grbit")))
    if "msysqueries" in low:
        for r in f.rows(f.find("MSysQueries")):
            side["queries"].append(tuple(r.get(k) for k in ("ObjectId", "Attribute", "Expression", "Flag", "Name1", "Name2", "Order")))
    kinds = {"objects": OBJECTS, "indexes": INDEXES, "properties": PROPERTIES, "relationships": RELATIONSHIPS, "queries": QUERIES}
    return Database(spark, tables=made, side={k: spark.createDataFrame(rows, kinds[k]) for k, rows in side.items()})
