from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from deskdb.catalog import INDEXES, RELATIONSHIPS, Database
from deskdb.errors import AnalysisError
from deskdb.functions.dates import from_serial, java_pattern, serial
from deskdb.functions.values import Style, guid, octal, python_text
from deskdb.render import dialects as D
from deskdb.render.boxes import retrieved
from deskdb.render.ddl import schema_lines, schema_text
from deskdb.render.lines import Delimited, delimited, delimited_text, inserts, json_lines, unescaped, write_delimited


@pytest.fixture(scope="module")
def values(spark):
    rows = [
        (True, 5, Decimal("1.2500"), 1.5, 0.1, 1e20, datetime(2020, 1, 2, 3, 4, 5), date(2020, 1, 2), b"a\"\0", 'q"uo,te\\', None, 7),
        (None, None, None, None, 100.0, -1e-7, None, None, None, "", "x\ty\r\n", None),
    ]
    return spark.createDataFrame(rows, "b boolean, i int, m decimal(19,4), f float, d double, e double, dt timestamp_ntz, sd date, bin binary, t string, u string, big bigint")


def lines(df):
    return [r["line"] for r in df.collect()]


def test_delimited(values):
    assert lines(delimited(values)) == ['1,5,1.2500,1.5,0.1,1e+20,"2020-01-02 03:04:05","2020-01-02","a""\0","q""uo,te\\",,7', '0,,,,100,-1e-07,,,,,"x\ty\r\n",']
    o = Delimited("|", quote="'", escape="\\", null="NULL", style=Style(words=True, binary="hex", datetime="%d/%m/%y %H:%M"))
    assert lines(delimited(values, o)) == ["TRUE|5|1.2500|1.5|0.1|1e+20|'02/01/20 03:04'|'2020-01-02'|'612200'|'q\"uo,te\\\\'|NULL|7", "FALSE|NULL|NULL|NULL|100|-1e-07|NULL|NULL|NULL|NULL|'x\ty\r\n'|NULL"]
    assert lines(delimited(values.select("u", "t"), Delimited(quoting=False, escape_invisible=True)))[1] == "x\\ty\\r\\n,"
    assert lines(delimited(values.select("bin"), Delimited(style=Style(binary="octal"))))[0] == '"\\141\\042\\000"'
    assert lines(delimited(values.select("bin"), Delimited(style=Style(binary="strip"))))[0] == '""'
    assert delimited_text(values.select("i", "t"), Delimited(row_end="\r\n")) == 'i,t\r\n5,"q""uo,te\\"\r\n,\r\n'


def test_files(spark, values, tmp_path):
    write_delimited(values.select("i", "t").coalesce(1), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*")] == ['i,t\n5,"q""uo,te\\"\n,\n']


def test_option_escapes():
    assert unescaped(r"\t\n\\n\x") == "\t\n\\n\\x"


def test_json(values):
    got = lines(json_lines(values))
    assert got[0] == '{"b":1,"i":5,"m":1.2500,"f":1.5,"d":0.1,"e":1e+20,"dt":"2020-01-02 03:04:05","sd":"2020-01-02","bin":{"$binary": "YSIA", "$type": "00"},"t":"q\\"uo,te\\\\","big":7}'
    assert got[1] == '{"b":0,"d":100,"e":-1e-07,"u":"x\\u0009y\\u000d\\u000a"}'
    assert lines(json_lines(values.select("u"), blank_controls=True))[1] == '{"u":"x y  "}'


@given(st.floats(-1e300, 1e300))
@settings(max_examples=100, deadline=None)
def test_double_text_reads_back(x):
    assert float(python_text(x)) == pytest.approx(x, rel=1e-15, abs=0)


def test_serials(spark):
    df = spark.createDataFrame([(datetime(2000, 1, 1, 12),), (datetime(1899, 12, 30),), (datetime(1955, 5, 5, 5, 5, 5),), (None,)], "t timestamp_ntz")
    got = df.select(serial(F.col("t")).alias("s"), from_serial(serial(F.col("t"))).alias("b"), "t").collect()
    assert [r["s"] for r in got][:2] == [36526.5, 0.0] and all(r["b"] == r["t"] for r in got)
    assert spark.createDataFrame([(-1.0,), (2e6,)], "s double").select(from_serial(F.col("s"))).collect() == [(None,), (None,)]


def test_patterns():
    assert java_pattern("%Y-%m-%d at %H:%M%%") == "yyyy-MM-dd 'a''t' HH:mm'%'"
    with pytest.raises(AnalysisError):
        java_pattern("%Q")


def test_guids_and_octal(spark):
    df = spark.createDataFrame([(bytes(range(16)),)], "g binary")
    assert df.select(guid(F.hex("g"), True), guid(F.hex("g"), False), octal(F.lit(b"\x01\xff"))).collect() == [("{03020100-0504-0706-08090A0B0C0D0E0F}", "03020100-0504-0706-0809-0A0B0C0D0E0F", "\\001\\377")]


def test_inserts(spark):
    df = spark.createDataFrame([(1, "a'b"), (2, None), (3, 'q"')], "k int, s string").coalesce(1)
    db = Database(spark, tables={"My T": df})
    rows = db.table("my t", storage_order=True)
    got = [r["line"] for r in inserts(rows, "My T", "postgres", batch=2, namespace="ns").orderBy("statement_no").collect()]
    assert got == ["INSERT INTO \"ns\".\"my t\" (\"k\", \"s\") VALUES (1, 'a''b'), (2, NULL);", "INSERT INTO \"ns\".\"my t\" (\"k\", \"s\") VALUES (3, 'q\"');"]
    got = [r["line"] for r in inserts(rows, "My T", "access").orderBy("statement_no").collect()]
    assert got[2] == 'INSERT INTO [My T] ([k], [s]) VALUES (3, "q""");' and len(got) == 3
    hexed = spark.createDataFrame([(b"\x01\xab",)], "b binary").coalesce(1)
    rows = Database(spark, tables={"t": hexed}).table("t", storage_order=True)
    for name, want in (("sqlite", "X'01AB'"), ("mysql", "0x01AB"), ("postgres", "decode('01AB', 'hex')")):
        assert f"VALUES ({want});" in inserts(rows, "t", name, style=Style(binary="hex")).head()["line"]


def test_quoting():
    assert D.quoted('a"b\n', '"') == '"a""b\\012"' and D.back_quoted("s", "n") == "`s_n`" and D.bracketed("s", "n") == "[s_n]" and D.double_quoted("s", "n") == '"s"."n"'
    with pytest.raises(AnalysisError):
        D.dialect("none")
    D.register_dialect(D.Dialect("mine", {}, frozenset(), "x", "y", D.bracketed))
    assert D.dialect("mine").identifier("A") == "[A]"
    del D.DIALECTS["mine"]


@pytest.fixture(scope="module")
def shop(spark):
    t = spark.createDataFrame([], "id int, ok boolean, name string, price decimal(19,4), at timestamp_ntz, n decimal(10,2), big bigint")
    side = {
        "indexes": spark.createDataFrame([("Shop", "pk", 1, 1, [("id", True)]), ("Shop", "u", 0, 1, [("name", True), ("id", False)]), ("Shop", "fk", 2, 0, [("id", False)]), ("Shop", "zero", 0, 0, [])], INDEXES),
        "relationships": spark.createDataFrame([("id", "Shop", "cid", "Owner", 0x1100), ("name", "Shop", "n", "Owner", 2)], RELATIONSHIPS),
        "properties": spark.createDataFrame(
            [("Shop", None, "Description", "The 'shop'"), ("Shop", "id", "autonumber", "true"), ("Shop", "id", "Required", "yes"), ("Shop", "name", "AllowZeroLength", "no"), ("Shop", "name", "DefaultValue", '"it\'s"'), ("Shop", "name", "Description", "c"),
             ("Shop", "at", "DefaultValue", "Date()"), ("Shop", "n", "DefaultValue", "5"), ("Shop", "ok", "DefaultValue", "Yes"), ("Shop", "at", "Format", "Short Date")],
            "table string, column string, name string, value string",
        ),
    }
    return Database(spark, tables={"Shop": t}, side=side)


EVERYTHING = {D.DROP, D.NOT_NULL, D.NOT_EMPTY, D.COMMENTS, D.INDEXES, D.RELATIONS, D.DEFAULTS}


def test_ddl_postgres(shop):
    got = schema_lines(shop, "postgres", namespace="NS", options=EVERYTHING)
    assert got == [
        "-- Schema written by deskdb", "", "SET client_encoding = 'UTF-8';", "", 'DROP TABLE IF EXISTS "ns"."shop";', 'CREATE TABLE IF NOT EXISTS "ns"."shop"', " (",
        '\t"id"\t\t\tSERIAL NOT NULL, ', '\t"ok"\t\t\tBOOLEAN NOT NULL DEFAULT TRUE, ', "\t\"name\"\t\t\tVARCHAR (255) DEFAULT 'it''s', ", '\t"price"\t\t\tNUMERIC(15,2), ', '\t"at"\t\t\tDATE DEFAULT current_date, ',
        '\t"n"\t\t\tNUMERIC (10, 2) DEFAULT 5, ', '\t"big"\t\t\tNUMERIC (19, 0)', ");", 'ALTER TABLE "ns"."shop" ADD CHECK ("name" <>\'\');', 'COMMENT ON COLUMN "ns"."shop"."name" IS \'c\';',
        "COMMENT ON TABLE \"ns\".\"shop\" IS 'The ''shop''';", "", "-- CREATE INDEXES ...", 'ALTER TABLE "ns"."shop" ADD CONSTRAINT "shop_pkey" PRIMARY KEY ("id");',
        'CREATE UNIQUE INDEX "shop_u_idx" ON "ns"."shop" ("name" DESC, "id");', '-- WARNING: found no keys for index "shop_zero_idx" - ignored', "", "", "-- CREATE Relationships ...",
        'ALTER TABLE "ns"."shop" ADD CONSTRAINT "shop_id_fk" FOREIGN KEY ("id") REFERENCES "ns"."owner"("cid") ON UPDATE CASCADE ON DELETE CASCADE DEFERRABLE INITIALLY IMMEDIATE;',
        '-- Relationship from "ns"."shop" ("name") to "ns"."owner"("n") does not enforce integrity.',
    ]


def test_ddl_others(shop):
    text = {d: schema_text(shop, d, options=EVERYTHING) for d in D.DIALECTS}
    assert "ALTER TABLE `Shop` ADD PRIMARY KEY (`id`);\nALTER TABLE `Shop` ADD UNIQUE INDEX `u` (`name` DESC, `id`);" in text["mysql"] and "int not null auto_increment unique NOT NULL" in text["mysql"]
    assert "\t, PRIMARY KEY (`id`)\n);" in text["sqlite"] and "PRIMARY KEY (`id`);" not in text["sqlite"] and "Relationships" not in text["sqlite"]
    assert "ON DELETE CASCADE;" in text["oracle"] and "ON UPDATE" not in text["oracle"] and 'DEFAULT current_date' in text["oracle"]
    assert "CREATE INDEXES" not in text["access"] and "[price]\t\t\tCurrency" in text["access"] and "DEFAULT Date()" in text["access"]
    assert 'ALTER TABLE "Shop" ADD CHECK ("name" <>\'\');' in text["sybase"] and "\"at\"\t\t\tDATE DEFAULT getdate()" in text["sybase"]


def test_footers():
    assert [retrieved(n) for n in (0, 1, 2)] == ["No Rows retrieved", "1 Row retrieved", "2 Rows retrieved"]
