"""A database: tables as DataFrames, and what is known about them beside their rows.

A database is a folder of Parquet tables (``<name>.parquet``, a file or a folder), or any DataFrames given by name. A folder may hold
side-car tables of metadata, ``_objects``, ``_indexes``, ``_relationships``, ``_properties`` and ``_queries`` (Parquet or JSON lines);
without them a database has no indexes, relationships, properties or stored queries. Folders are listed through Hadoop's file system, so
that any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from deskdb.errors import AnalysisError

#: Object types of the catalog, by number.
OBJECT_TYPES = {0: "form", 1: "table", 2: "macro", 3: "systable", 4: "report", 5: "query", 6: "linkedtable", 7: "module", 8: "relationship", 9: "unknown", 10: "userinfo", 11: "dbprop"}
#: Flags of a table that is not a user's.
SYSTEM_FLAGS = 0x80000002

OBJECTS = "id int, name string, type int, flags long, props map<string,string>"
INDEXES = "table string, name string, index_type int, flags int, keys array<struct<col:string,desc:boolean>>"
RELATIONSHIPS = "szColumn string, szObject string, szReferencedColumn string, szReferencedObject string, grbit int"
PROPERTIES = "table string, column string, name string, value string"
QUERIES = "object_id int, attribute int, expression string, flag int, name1 string, name2 string, order binary"
SIDE = {"objects": OBJECTS, "indexes": INDEXES, "relationships": RELATIONSHIPS, "properties": PROPERTIES, "queries": QUERIES}

#: Order of rows in storage: the file, then the row's place in it.
STORAGE_ORDER = ("__desk_file", "__desk_row")


class Database:
    """``path`` is a folder of Parquet tables; ``tables`` gives DataFrames instead of it, or besides."""

    def __init__(self, spark: SparkSession, path: str | None = None, tables: dict[str, DataFrame] | None = None, side: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self.given, self.side_given = dict(tables or {}), dict(side or {})
        self._files: dict[str, str] | None = None
        self._fields: dict[str, T.StructType] = {}

    def _listing(self) -> dict[str, str]:
        """Names of what the folder holds, without their endings, and their paths."""
        if self._files is None:
            self._files = {}
            if self.path:
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(self.path)
                store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                if not store.exists(at):
                    raise AnalysisError(f"no database at {self.path}")
                for status in store.listStatus(at):
                    name = status.getPath().getName()
                    if name.endswith((".parquet", ".json")):
                        self._files[name.rpartition(".")[0]] = f"{self.path}/{name}"
        return self._files

    def names(self) -> list[str]:
        """Tables, in the catalog's order: by object number where there is a side-car, else by name."""
        found = {**{n: None for n in self._listing() if not n.startswith("_")}, **self.given}
        ranks = {r["name"]: r["id"] for r in self.side("objects").collect()} if self.has_side("objects") else {}  # one row an object
        return sorted(found, key=lambda n: (ranks.get(n, 1 << 40), n))

    def find(self, name: str) -> str:
        """A table's own spelling; capitals don't matter, an exact match goes first."""
        names = [*self.given, *(n for n in self._listing() if not n.startswith("_"))]
        found = [n for n in names if n == name] or [n for n in names if n.lower() == name.lower()]
        if not found:
            raise AnalysisError(f"{name} is not a table in this database")
        return found[0]

    def stored(self, name: str) -> bool:
        """Whether a table's rows have places in files."""
        return self.find(name) not in self.given

    def table(self, name: str, storage_order: bool = False) -> DataFrame:
        """A table's rows; with ``storage_order``, the two columns STORAGE_ORDER besides."""
        own = self.find(name)
        if own in self.given:
            df = self.given[own]
            return df.withColumns({STORAGE_ORDER[0]: F.lit(""), STORAGE_ORDER[1]: F.monotonically_increasing_id()}) if storage_order else df
        df = self.spark.read.parquet(self._listing()[own])
        if storage_order:
            df = df.select("*", F.col("_metadata.file_path").alias(STORAGE_ORDER[0]), F.col("_metadata.row_index").alias(STORAGE_ORDER[1]))
        return df

    def schema(self, name: str) -> T.StructType:
        """A table's columns, with the properties of the side-car as their metadata."""
        own = self.find(name)
        if own not in self._fields:
            fields = self.table(own).schema
            known: dict[str, dict[str, str]] = {}
            if self.has_side("properties"):
                for r in self.side("properties").filter(F.col("table") == own).filter("column is not null and column <> ''").collect():  # a few rows a column
                    known.setdefault(r["column"], {})[r["name"]] = r["value"]
            self._fields[own] = T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), **known.get(f.name, {})}) for f in fields])
        return self._fields[own]

    def has_side(self, name: str) -> bool:
        return name in self.side_given or f"_{name}" in self._listing()

    def side(self, name: str) -> DataFrame:
        """A side-car table; empty where there is none."""
        if name in self.side_given:
            return self.side_given[name]
        if self.has_side(name):
            path = self._listing()[f"_{name}"]
            return self.spark.read.schema(SIDE[name]).json(path) if path.endswith(".json") else self.spark.read.parquet(path)
        return self.spark.createDataFrame([], SIDE[name])

    def table_properties(self, name: str) -> dict[str, str]:
        own = self.find(name)
        if not self.has_side("properties"):
            return {}
        return {r["name"]: r["value"] for r in self.side("properties").filter(F.col("table") == own).filter("column is null or column = ''").collect()}

    def objects(self) -> DataFrame:
        """id, name, type, object_type, flags, is_system, props of every object. Without a side-car, the tables."""
        if self.has_side("objects"):
            found = self.side("objects")
        else:
            rows = [(k + 1, n, 1, 0, {}) for k, n in enumerate(self.names())]
            found = self.spark.createDataFrame(rows, OBJECTS)
        kinds = F.create_map(*[x for k, v in OBJECT_TYPES.items() for x in (F.lit(k), F.lit(v))])
        system = (F.col("type") == 1) & (F.col("flags").cast("long").bitwiseAND(F.lit(SYSTEM_FLAGS)) != 0)
        return found.select("id", "name", "type", F.coalesce(kinds[F.col("type")], F.lit("unknown")).alias("object_type"), "flags", F.coalesce(system, F.lit(False)).alias("is_system"), "props")
