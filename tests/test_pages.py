import struct
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st

from deskdb.engine import Engine
from deskdb.render.ddl import schema_text
from deskdb.sources.pagefile import database, read_bytes, read_table, version
from deskdb.sources.pages import PageError, PageFile, rc4, squeezed, wide_text
from deskdb.sources.pagewriter import Writer, property_block

col = lambda name, code, fixed, length, **more: {"name": name, "code": code, "fixed": fixed, "length": length, **more}
COLUMNS = [
    col("id", 4, True, 4, flags=4), col("flag", 1, True, 0), col("tiny", 2, True, 1), col("small", 3, True, 2), col("cash", 5, True, 8), col("single", 6, True, 4), col("real", 7, True, 8),
    col("at", 8, True, 8), col("day", 8, True, 8), col("num", 16, True, 17, precision=18, scale=3), col("guid", 15, True, 16),
    col("name", 10, False, 100), col("memo", 12, False, 0), col("blob", 11, False, 0), col("raw", 9, False, 50),
]
GUID = bytes(range(16))


def numeric(whole, negative=False):
    return bytes([0x80 if negative else 0]) + b"".join(((whole >> 32 * (3 - k)) & 0xFFFFFFFF).to_bytes(4, "little") for k in range(4))


def sample(wide=True, kind=0, key=0):
    w = Writer(wide, key)
    long = "long text " * 900
    rows = [
        [struct.pack("<i", 1), True, b"\xff", struct.pack("<h", -5), struct.pack("<q", -12345), struct.pack("<f", 1.5), struct.pack("<d", 2.25), struct.pack("<d", 36526.5), struct.pack("<d", 2.0), numeric(1234567), GUID, w.text("Ann"), w.inline(w.text("short")), w.inline(b"\0\1"), b"ab"],
        [struct.pack("<i", 2), False, *[None] * 13],
        [struct.pack("<i", 3), True, b"\0", struct.pack("<h", 7), struct.pack("<q", 5), None, None, struct.pack("<d", -1.0), None, numeric(5, True), None, w.text("Zoë"), w.single(w.text("x" * 1000)), w.chain(b"\7" * 5000, 1500), None],
        [struct.pack("<i", 4), False, *[None] * 9, w.text("d" * 50), w.chain(long.encode("utf-16-le" if wide else "cp1252"), 1500), None, None],
    ]
    moved = w.data_page(b"ELSE", [(w.row(COLUMNS, [struct.pack("<i", 5), False, *[None] * 9, w.text("moved"), None, None, None]), 0)])
    ready = [(w.row(COLUMNS, r), 0) for r in rows] + [(w.row(COLUMNS, rows[1]), 0x8000), (struct.pack("<I", moved << 8), 0x4000)]
    indexes = [{"name": "PrimaryKey", "kind": 1, "flags": 1, "keys": [(0, False)]}, {"name": "ByName", "kind": 0, "flags": 0, "keys": [(11, True), (0, False)]}]
    n = w.table(COLUMNS, ready, per_page=2, kind=kind, indexes=indexes)
    props = property_block(["Description", "Required", "DefaultValue", "Format"], [("", [(0, 10, "About it".encode("utf-16-le" if wide else "cp1252"))]), ("id", [(1, 1, b"\1")]), ("name", [(2, 12, '"x"'.encode("utf-16-le" if wide else "cp1252"))]), ("day", [(3, 10, "Short Date".encode("utf-16-le" if wide else "cp1252"))])], wide)
    return w.bytes([(n, "Asset Items", 1, 0, props), (2, "MSysObjects", 1, 0x80000000, None), (77, "qry", 5, 0, None)]), long


@pytest.mark.parametrize("wide", [True, False])
@pytest.mark.parametrize("kind,key", [(0, 0), (1, 0), (9, 0), (0, 0x1234)])
def test_rows_of_every_type(wide, kind, key):
    data, long = sample(wide, kind, key)
    f = PageFile.of_bytes(data)
    rows = {r["id"]: r for r in f.rows(f.find("asset items"))}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1] == {
        "id": 1, "flag": True, "tiny": 255, "small": -5, "cash": Decimal("-1.2345"), "single": 1.5, "real": 2.25, "at": datetime(2000, 1, 1, 12), "day": datetime(1900, 1, 1), "num": Decimal("1234.567"),
        "guid": "03020100-0504-0706-0809-0a0b0c0d0e0f", "name": "Ann", "memo": "short", "blob": b"\0\1", "raw": b"ab",
    }
    assert rows[2] == {c["name"]: None for c in COLUMNS} | {"id": 2, "flag": False}
    assert rows[3]["at"] is None and rows[3]["num"] == Decimal("-0.005") and rows[3]["memo"] == "x" * 1000 and rows[3]["blob"] == b"\7" * 5000
    assert rows[4]["memo"] == long and rows[5]["name"] == "moved"
    assert f.version == ("JET4" if wide else "JET3")


def test_data_source(spark, tmp_path):
    data, long = sample()
    path = tmp_path / "a.mdb"
    path.write_bytes(data)
    df = read_table(spark, f"file://{path}", "Asset Items").select("id", "name", "cash", "at")
    assert [tuple(r) for r in df.orderBy("id").limit(2).collect()] == [(1, "Ann", Decimal("-1.2345"), datetime(2000, 1, 1, 12)), (2, None, None, None)]
    assert version(str(path)) == "JET4"
    assert read_bytes(spark, str(path), "Asset Items").count() == 5
    db = database(spark, f"file://{path}")
    e = Engine(spark, db)
    assert [r["Tables"] for r in e.execute("LIST TABLES").collect()] == ["Asset Items"]
    assert e.execute("SELECT id FROM [asset items] WHERE memo LIKE 'long%' OR num = 1234.567").orderBy("id").collect() == [(1,), (4,)]
    assert e.execute("SELECT day FROM [asset items] WHERE id = 1").collect() == [(date(1900, 1, 1),)]
    assert e.execute("SELECT COUNT(*) FROM [Asset Items] WHERE flag = 1").collect() == [(2,)]
    described = {r[0]: (r[1], r[2]) for r in e.execute("DESCRIBE TABLE [Asset Items]").collect()}
    assert described["memo"] == ("Memo/Hyperlink", "0") and described["name"] == ("Text", "100") and described["tiny"] == ("Byte", "1")
    ddl = schema_text(db, "postgres", options={"not null", "defaults", "comments", "indexes"})
    assert '"id"\t\t\tSERIAL NOT NULL' in ddl and "\"name\"\t\t\tVARCHAR (50) DEFAULT 'x'" in ddl and '"day"\t\t\tDATE' in ddl and "COMMENT ON TABLE \"asset items\" IS 'About it';" in ddl
    assert 'ADD CONSTRAINT "asset items_pkey" PRIMARY KEY ("id");' in ddl and 'CREATE INDEX "asset items_byname_idx" ON "asset items" ("name" DESC, "id");' in ddl


def test_partitions_cover_all_pages(spark, tmp_path):
    w = Writer()
    columns = [col("n", 4, True, 4)]
    n = w.table(columns, [[struct.pack("<i", k)] for k in range(1000)], per_page=10, kind=1)
    path = tmp_path / "b.mdb"
    path.write_bytes(w.bytes([(n, "t", 1, 0, None)]))
    read_table(spark, str(path), "t")
    df = spark.read.format("deskpages").option("table", "t").option("path", str(path)).option("pagesPerTask", 7).load()
    assert df.rdd.getNumPartitions() == 15 and sorted(r[0] for r in df.collect()) == list(range(1000))


def test_long_definitions_span_pages():
    w = Writer()
    columns = [col(f"a column with a long name {k}", 4, True, 4) for k in range(200)]
    n = w.table(columns, [[struct.pack("<i", k) for k in range(200)]])
    f = PageFile.of_bytes(w.bytes([(n, "wide", 1, 0, None)]))
    assert list(next(f.rows(f.find("wide"))).values()) == list(range(200))


def test_later_columns_are_null():
    w = Writer()
    old = [col("a", 4, True, 4), col("t", 10, False, 50)]
    new = [*old, col("b", 4, True, 4), col("u", 10, False, 50)]
    n = w.table(new, [(w.row(old, [struct.pack("<i", 1), w.text("xyz")]), 0)])
    f = PageFile.of_bytes(w.bytes([(n, "t", 1, 0, None)]))
    assert list(f.rows(f.find("t"))) == [{"a": 1, "t": "xyz", "b": None, "u": None}]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_text_codec(s):
    s = s.encode("utf-16-le", "ignore").decode("utf-16-le", "ignore")
    if "\0" not in s and not s.startswith("﻿"):
        assert wide_text(squeezed(s)) == s


def test_mixed_compression():
    assert wide_text(b"\xff\xfeab\0" + "éx日".encode("utf-16-le") + b"\0c") in ("abéx日c", "abéx日" + "c")


def test_rc4_known_answer():
    assert rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


@given(st.binary(max_size=300), st.integers(0, 40_000))
@settings(max_examples=150, deadline=None)
def test_damaged_files_raise_only_page_errors(noise, at):
    data = bytearray(sample()[0])
    at %= len(data)
    data[at : at + len(noise)] = noise[: len(data) - at]
    try:
        f = PageFile.of_bytes(bytes(data))
        for o in f.objects():
            f.properties(o["props"])
            if o["type"] == 1:
                list(f.rows(f.table(int(o["id"]) & 0xFFFFFF)))
    except PageError:
        pass


def test_not_a_database():
    with pytest.raises(PageError):
        PageFile.of_bytes(b"x" * 5000)
