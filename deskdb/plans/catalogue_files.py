"""Registered queries over page files: the rows of ``nation`` and ``region`` (25 and 5 at any scale) written in the format and read again."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, functions as F

from deskdb import metadata
from deskdb.catalog import Database
from deskdb.plans.catalogue import _call, _values
from deskdb.plans.catalogue_values import _lines, _listed
from deskdb.scratch import scratch_path
from deskdb.sources.pagefile import database, read_bytes, read_table, version
from deskdb.sources.pages import PageFile, squeezed, wide_text
from deskdb.sources.pagewriter import Writer, property_block

_COLUMNS = [
    {"name": "key", "code": 4, "fixed": True, "length": 4, "flags": 4}, {"name": "low", "code": 1, "fixed": True, "length": 0}, {"name": "cash", "code": 5, "fixed": True, "length": 8}, {"name": "share", "code": 7, "fixed": True, "length": 8},
    {"name": "at", "code": 8, "fixed": True, "length": 8}, {"name": "name", "code": 10, "fixed": False, "length": 100}, {"name": "about", "code": 12, "fixed": False, "length": 0}, {"name": "raw", "code": 11, "fixed": False, "length": 0},
]
_CHAIN = 1500


def _page_bytes(db: Database, wide: bool = True, kind: int = 0, key: int = 0, moved: bool = False) -> bytes:
    """nation as a page file: every third name is null, notes are long values of each storage, keys divisible by 10 are rows that moved where asked for, beside a deleted row."""
    w, rows = Writer(wide, key), []
    for r in db.table("nation").orderBy("n_nationkey").collect():  # 25 rows
        k, name = r["n_nationkey"], r["n_name"]
        note = name * (1 + 400 * (k % 3))
        raw = (note.encode("utf-16-le") if wide else note.encode("cp1252")) if k % 3 else w.text(note)
        about = (w.inline, w.single, lambda x: w.chain(x, _CHAIN))[k % 3](raw if k % 3 != 1 or len(raw) < w.at.page - 200 else w.text(note)[: w.at.page - 300])
        row = w.row(_COLUMNS, [struct.pack("<i", k), r["n_regionkey"] < 2, struct.pack("<q", 12345 * k - 50_000), struct.pack("<d", k / 8), struct.pack("<d", 36526 + k * 1.25), w.text(name) if k % 3 else None, about, w.single(name.encode())])
        if moved and k % 10 == 0:
            rows.append((struct.pack("<I", w.data_page(b"ELSE", [(row, 0)]) << 8), 0x4000))
        else:
            rows.append((row, 0))
    rows.insert(3, (rows[1][0], 0x8000))
    indexes = [{"name": "PrimaryKey", "kind": 1, "flags": 1, "keys": [(0, False)]}, {"name": "ByName", "kind": 0, "flags": 0, "keys": [(5, True), (0, False)]}]
    n = w.table(_COLUMNS, rows, per_page=4, kind=kind, indexes=indexes)
    enc = lambda s: s.encode("utf-16-le" if wide else "cp1252")
    props = property_block(["Description", "Required"], [("", [(0, 10, enc("All nations"))]), ("name", [(1, 1, b"\1")])], wide)
    return w.bytes([(n, "Asset Nations", 1, 0, props), (2, "MSysObjects", 1, 0x80000000, None), (77, "qry", 5, 0, None)])


def _page_file(db: Database, **how) -> str:
    spark, path = db.spark, scratch_path(db.spark, "pages") + ".mdb"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(_page_bytes(db, **how)))
    out.close()
    return path


_PICKED = ["key", "low", "cash", "share", "at", "name", "raw"]
_ROWS = """SELECT n_nationkey AS key, n_regionkey < 2 AS low, CAST(n_nationkey * 1.2345 - 5 AS DECIMAL(19,4)) AS cash, n_nationkey / 8 AS share, TIMESTAMP '2000-01-01' + n_nationkey * INTERVAL 30 HOUR AS "at",
CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name, encode(n_name) AS raw FROM nation"""
for _name, _how in (("page_rows", {}), ("page_rows_jet3", {"wide": False}), ("page_map_of_pages", {"kind": 1}), ("page_map_unknown", {"kind": 9}), ("page_encrypted", {"key": 0x1234}), ("page_moved_rows", {"moved": True})):
    _call(_name, lambda db, how=_how: read_table(db.spark, _page_file(db, **how), "asset nations").select(*_PICKED), _ROWS)
_call("page_in_memory", lambda db: read_bytes(db.spark, _page_file(db), "Asset Nations").select(*_PICKED), _ROWS)
_call("page_long_values", lambda db: read_table(db.spark, _page_file(db), "Asset Nations").filter("key % 3 <> 1").select("key", F.length("about").alias("n"), F.md5(F.col("about").cast("binary")).alias("digest")), "SELECT n_nationkey AS key, length(x) AS n, md5(x) AS digest FROM (SELECT n_nationkey, repeat(n_name, 1 + 400 * (n_nationkey % 3)) AS x FROM nation) WHERE n_nationkey % 3 <> 1")
_call("page_versions", lambda db: _lines(db, [version(_page_file(db)), version(_page_file(db, wide=False)), PageFile.of_bytes(_page_bytes(db, key=99)).version, metadata.version(db)]), _listed(["JET4", "JET3", "JET4", "PARQUET"]))
_call("page_properties", lambda db: metadata.properties(database(db.spark, _page_file(db)), "Asset Nations"), _values(["column", "name", "value"], [(None, "Description", "All nations"), ("name", "Required", "yes")], ["VARCHAR"] * 3))
_call("page_objects", lambda db: metadata.list_objects(database(db.spark, _page_file(db)), "any", True), _values(["name", "type", "object_type"], [("Asset Nations", 1, "table"), ("MSysObjects", 1, "table"), ("qry", 5, "query")]))


def _indexes(db: Database) -> DataFrame:
    return metadata.indexes(database(db.spark, _page_file(db)), "Asset Nations").select("name", "index_type", F.to_json("keys").alias("keys"))


_call("page_indexes", _indexes, _values(["name", "index_type", "keys"], [("PrimaryKey", 1, '[{"col":"key","desc":false}]'), ("ByName", 0, '[{"col":"name","desc":true},{"col":"key","desc":false}]')]))
_call(
    "text_codec",
    lambda db: db.spark.createDataFrame([(r["r_name"], wide_text(squeezed(r["r_name"])), wide_text(squeezed(r["r_name"] + " 日本")), len(squeezed(r["r_name"]))) for r in db.table("region").collect()], "r_name string, back string, far string, size int"),
    "SELECT r_name, r_name AS back, r_name || ' 日本' AS far, 2 + length(r_name)::INT AS size FROM region",
)
