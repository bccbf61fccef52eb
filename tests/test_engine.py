from datetime import date, datetime
from decimal import Decimal

import pytest

from deskdb import metadata
from deskdb.catalog import QUERIES, Database
from deskdb.engine import Engine, connection
from deskdb.errors import AnalysisError, DeskError, NotConnected, ParseError
from deskdb.operators.change import append_to, appended, rewrite, updated
from deskdb.operators.ingest import import_csv, read_csv
from deskdb.plans.shell import Shell
from deskdb.sql import nodes as N
from deskdb.sql.parser import parse
from deskdb.sql.tokens import statements, strip_escapes
from deskdb.streaming.follow import follow, follow_folder

ALL = "b boolean, by short, i short, l int, m decimal(19,4), f float, d double, dt timestamp_ntz, sd date, bin binary, t string, n decimal(18,3), big bigint"
ROWS = [
    (True, 200, -5, 7, Decimal("1.2500"), 1.5, 2.5, datetime(2000, 1, 1, 12), date(2000, 1, 1), b"ab", "Ann", Decimal("1.250"), 5),
    (False, 0, 32767, -(2**31), Decimal("-922337203685477.5808"), 1e20, -1e-10, datetime(1899, 12, 30), date(1899, 12, 30), b"", "x" * 255, Decimal("-0.001"), 2**62),
    (False, *[None] * 12),
]


@pytest.fixture(scope="module")
def engine(spark):
    tables = {
        "all_types": spark.createDataFrame(ROWS, ALL),
        "null_logic": spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 3, "c%_\\"), (4, 0, "A")], "k int, v int, s string"),
        "Asset Items": spark.createDataFrame([(1, "x", 2)], "`Ship Name` int, `Größe` string, `order` int"),
    }
    return Engine(spark, Database(spark, tables=tables))


def ids(engine, where, table="null_logic", key="k"):
    return sorted(r[0] for r in engine.execute(f"SELECT {key} FROM {table} WHERE {where}").collect())


@pytest.mark.parametrize(
    "where,want",
    [
        ("v = 1", [1]), ("v <> 1", [3, 4]), ("NOT v = 1", [3, 4]), ("v IS NULL", [2]), ("v is not null", [1, 3, 4]), ("NOT v IS NULL", [1, 3, 4]), ("v > 0 OR s = 'A'", [1, 3, 4]),
        ("v = 1.9", [1]), ("v = -0.5", [4]), ("3 <= v", [3]), ("s LIKE 'a'", [1]), ("s ILIKE 'A'", [1, 4]), ("s LIKE 'c%'", [3]), ("s LIKE '%\\'", [3]), ("s LIKE '____'", [3]), ("NOT s LIKE 'a'", [3, 4]),
        ("s = 'a' OR s = 'A' AND v = 1", [1]), ("( s = 'a' OR s = 'A' ) AND v = 0", [4]), ("(v=1)", [1]), ("1 = 2 OR v = 1", [1]), ("1 = 1.9", [1, 2, 3, 4]), ("'b' > 'a'", [1, 2, 3, 4]), ("'abc' ILIKE 'A_C'", [1, 2, 3, 4]),
        ("NOT NOT v = 1", [1]), ("v >= 1 AND v <= 1e0", [1]), ("V = 1 and S = 'a'", [1]), ("[v] = 1", [1]), ('"v" = 1', [1]),
    ],
)
def test_predicates(engine, where, want):
    assert ids(engine, where) == want


@pytest.mark.parametrize(
    "where,n",
    [
        ("b = 1", 1), ("b = 0", 2), ("b <> 1", 2), ("by > 100", 1), ("i < 0", 1), ("m = 1.25", 1), ("m < 0", 1), ("n = -0.001", 1), ("f > 1", 2), ("d < 0", 1), ("l < -2000000000", 1), ("big = 4611686018427387904", 1),
        ("dt = 946728000", 1), ("dt = 36526.5", 1), ("dt < strptime('1900','%Y')", 1), ("sd = strptime('2000-01-01','%Y-%m-%d')", 1), ("bin = 'ab'", 1), ("t LIKE 'x%'", 1), ("dt = strptime('00:00','%H:%M')", 1),
    ],
)
def test_every_type(engine, where, n):
    assert engine.execute(f"SELECT COUNT(*) FROM all_types WHERE {where}").collect() == [(n,)]


@pytest.mark.parametrize("where", ["t = 1", "l = 'x'", "nothing = 1", "dt = 'x'", "l LIKE '1'", "b = 'yes'", "l = strptime('2000','%Y')"])
def test_wrong_comparisons(engine, where):
    with pytest.raises(AnalysisError):
        engine.execute(f"SELECT * FROM all_types WHERE {where}")


@pytest.mark.parametrize(
    "sql",
    ["SELECT", "SELECT * FROM", "SELECT a b FROM t", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE a = b", "SELECT * FROM t WHERE 1 = 'x'", "SELECT TOP 2 * FROM t LIMIT 3", "SELECT TOP 101 PERCENT * FROM t",
     "SELECT * FROM t, u", "DELETE FROM t", "SELECT * FROM t WHERE 'x' IS NULL", "SELECT * FROM t WHERE 'a' LIKE s", "SELECT * FROM t WHERE a = strptime('x','%Y')", "SELECT sum(a) FROM t", "SELECT * FROM t ORDER BY a", "SELECT ? FROM t"],
)
def test_not_of_the_dialect(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_names(engine):
    got = engine.execute('SELECT [ship name], "größe", [Order] FROM [asset items]')
    assert got.columns == ["ship name", "größe", "Order"] and got.collect() == [(1, "x", 2)]
    assert engine.execute("SELECT k, k FROM null_logic LIMIT 1").collect() == [(1, 1)]
    with pytest.raises(AnalysisError):
        engine.execute("SELECT nope FROM null_logic")
    with pytest.raises(AnalysisError):
        engine.execute("SELECT * FROM nope")


def test_limits(engine):
    count = lambda sql: len(engine.execute(sql).collect())
    assert count("SELECT * FROM null_logic LIMIT 2") == 2 and count("SELECT TOP 0 * FROM null_logic") == 0 and count("SELECT * FROM null_logic LIMIT -3") == 4
    assert [r[0] for r in engine.execute("SELECT TOP 2 k FROM null_logic WHERE k > 1").collect()] == [2, 3]
    assert count("SELECT TOP 50 PERCENT * FROM null_logic WHERE k > 1") == 2 and count("SELECT TOP 10 PERCENT * FROM null_logic") == 0
    assert engine.execute("SELECT TOP 50 PERCENT COUNT(*) FROM null_logic").collect() == [(4,)]


def test_collation(spark, engine):
    turned = Engine(spark, engine.db, collation="UNICODE_CI")
    assert ids(turned, "s = 'a'") == [1, 4] and ids(engine, "s = 'a'") == [1]


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) s", "id * 2 x").write.parquet(str(tmp_path / "t.parquet"))
    e = Engine(spark, str(tmp_path))
    plan = e.explain("SELECT id FROM t WHERE s LIKE '1%' AND id > 5")
    assert "StringStartsWith(s,1)" in plan and "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint,s:string>" in plan and "Exchange" not in plan
    assert "TakeOrderedAndProject" in e.explain("SELECT TOP 5 id FROM t")
    assert [r[0] for r in e.execute("SELECT TOP 3 id FROM t WHERE id > 7").collect()] == [8, 9, 10]


def test_connections(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "one.parquet"))
    e = Engine(spark, sources={"mine": str(tmp_path)}, folders=[str(tmp_path.parent)])
    with pytest.raises(NotConnected):
        e.execute("LIST TABLES")
    with pytest.raises(NotConnected):
        e.execute("DISCONNECT")
    for sql in (f"CONNECT TO '{tmp_path}'", "CONNECT TO mine", f'CONNECT TO "{tmp_path.name}"'):
        assert e.execute(sql).collect() == [] and e.execute("list tables").collect() == [("one",)]
        e.execute("DISCONNECT")
    e.connect(f"DBQ={tmp_path};UID=x")
    assert e.execute("SELECT COUNT(*) FROM ONE").collect() == [(3,)]
    e.connect("DSN=mine")
    with pytest.raises(AnalysisError):
        e.connect("nowhere at all")
    assert connection("DBQ={a;b};Pwd = x") == {"dbq": "a;b", "pwd": "x"}


def test_cursor(engine):
    c = engine.cursor().prepare("SELECT k, v FROM null_logic").execute()
    assert c.fetchone() == (1, 1) and c.fetchmany(2) == [(2, None), (3, 3)] and c.fetchall() == [(4, 0)] and c.fetchone() is None
    c.rewind()
    row = c.fetchone()
    assert c.get(row, 1, "tinyint") == 1 and c.description[0][:2] == ("k", "Long Integer")
    c.close()
    assert c.fetchone() is None


@pytest.mark.parametrize("value,to,want", [(300, "tinyint", metadata.OutOfRange), (255, "utinyint", 255), (-1, "utinyint", metadata.OutOfRange), ("12", "integer", 12), ("x", "integer", metadata.NotImplementedType), (2.9, "smallint", 2), (2, "bit", metadata.OutOfRange), (True, "bit", 1), (None, "integer", None), (datetime(2000, 1, 2, 3, 4), "date", date(2000, 1, 2)), (b"a", "double", metadata.NotImplementedType), (1.5, "char", "1.5"), ("é", "binary", "é".encode()), (1, "interval", metadata.NotImplementedType), ("1.5", "numeric", Decimal("1.5"))])
def test_conversions(value, to, want):
    if isinstance(want, type):
        with pytest.raises(want):
            metadata.convert(value, to)
    else:
        assert metadata.convert(value, to) == want


def test_chunks():
    assert list(metadata.chunks("abcde", 2)) == [("ab", True), ("cd", True), ("e", False)] and list(metadata.chunks(None, 2)) == [(None, False)]


def test_script_splitting():
    assert statements("select 1; select ';' ;\nGO\nx 'a''b;' [c;d]\ngo\n") == ["select 1", "select ';'", "x 'a''b;' [c;d]"]
    assert strip_escapes("a = {d '2020-01-01'} and b = '{x}'").split() == "a = '2020-01-01' and b = '{x}'".split()


def test_metadata(spark):
    side = {
        "objects": spark.createDataFrame([(3, "b", 1, 0, {}), (2, "a", 1, 0, {}), (1, "MSysObjects", 1, -(2**31), {}), (9, "q", 5, 0, {}), (10, "f", 0, 0, {})], "id int, name string, type int, flags long, props map<string,string>"),
        "queries": spark.createDataFrame([(9, 5, None, None, "a", None, b"\0"), (9, 6, "x", None, None, None, b"\1"), (9, 6, "y", None, None, None, b"\0")], QUERIES),
        "properties": spark.createDataFrame([("a", None, "Description", "d"), ("a", "x", "Required", "yes")], "table string, column string, name string, value string"),
    }
    db = Database(spark, tables={n: spark.range(1).toDF("x") for n in ("b", "a", "MSysObjects")}, side=side)
    assert [r[0] for r in metadata.list_tables(db).collect()] == ["a", "b"]
    assert [r[0] for r in metadata.list_objects(db, "any", system=True).collect()] == ["MSysObjects", "a", "b", "q", "f"]
    assert [r[0] for r in metadata.list_objects(db, "systable").collect()] == ["MSysObjects"] and [r[0] for r in metadata.list_objects(db, "form").collect()] == ["f"]
    assert sorted((r["TABLE_NAME"], r["TABLE_TYPE"]) for r in metadata.client_tables(db).collect()) == [("MSysObjects", "SYSTEM TABLE"), ("a", "TABLE"), ("b", "TABLE"), ("q", "VIEW")]
    assert metadata.stored_query(db, "q") == "SELECT y,x FROM [a] " and [r[0] for r in metadata.stored_queries(db).collect()] == ["q"]
    with pytest.raises(DeskError):
        metadata.stored_query(db, "none")
    assert db.schema("A")["x"].metadata == {"Required": "yes"} and db.table_properties("a") == {"Description": "d"}
    assert metadata.count(db, "a") == 1 and metadata.version(db) == "MEMORY" and metadata.properties(db, "a").count() == 2


def test_changes(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "k int, s string, d double").write.parquet(path)
    append_to(path, spark.createDataFrame([("z", 3)], "S string, K int"))
    rewrite(spark, path, {"s": "new", "D": 2}, "k >= 2 AND NOT s = 'z'")
    assert sorted(spark.read.parquet(path).collect()) == [(1, "a", None), (2, "new", 2.0), (3, "z", None)]
    with pytest.raises(AnalysisError):
        appended(spark.range(1), spark.createDataFrame([(1,)], "other int"))
    assert updated(spark.range(2).toDF("k"), {"k": None}, "k = 1").collect() == [(0,), (None,)]
    with pytest.raises(ParseError):
        updated(spark.range(2).toDF("k"), {"k": 1}, "k = 1 LIMIT 2")


def test_csv_import(spark, tmp_path):
    (tmp_path / "in.csv").write_text('title;more\nhead;x;y\n"a;""q""";10;1\nplain;;\n"b";-7;0\n')
    schema = spark.createDataFrame([], "t string, i int, b boolean").schema
    got = [("a;\"q\"", 10, True), ("plain", None, False), ("b", -7, False)]
    assert read_csv(spark, str(tmp_path / "in.csv"), schema, delimiter=";", skip=2).collect() == got
    (tmp_path / "one.csv").write_text('t,i,b\n"line\nbreak",1,true\n')
    table = str(tmp_path / "t.parquet")
    spark.createDataFrame([], schema).write.parquet(table)
    assert import_csv(spark, str(tmp_path / "one.csv"), table, multi_line=True) == 1
    assert spark.read.parquet(table).collect() == [("line\nbreak", 1, True)]
    for bad in ("x,ten,1\n", "x,1,maybe\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            read_csv(spark, str(tmp_path / "bad.csv"), schema, skip=0).collect()
    with pytest.raises(AnalysisError):
        read_csv(spark, "x", spark.createDataFrame([], "d double").schema)


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(10).selectExpr("cast(id as int) k", "cast(id as string) s").write.parquet(str(src))
    df = follow_folder(spark, str(src), spark.read.parquet(str(src)).schema, "SELECT S FROM any WHERE k > 6")
    q = df.writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    spark.createDataFrame([(100, "late")], "k int, s string").write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert sorted(r["S"] for r in spark.table("followed").collect()) == ["7", "8", "9", "late"]
    with pytest.raises(AnalysisError):
        follow(spark.range(1), "SELECT TOP 1 id FROM t")


def test_shell(engine):
    out = list(Shell(engine).run("select k, s from null_logic where k = 1;\nselect nope from null_logic\ngo\nset noexec on\nselect * from null_logic;\nset what on\nquit\nselect 1"))
    assert out[:2] == ["+" + "-" * 11 + "+" + "-" * 255 + "+", "|k" + " " * 10 + "|s" + " " * 254 + "|"]
    assert out[3] == "|1" + " " * 10 + "|a" + " " * 254 + "|" and out[5] == "1 Row retrieved"
    assert out[6:] == ["Error: Column nope not found", "Unknown setting what"]
    assert list(Shell(engine, pretty=False, delimiter="|").run("select k, v from null_logic where k < 3;")) == ["k|v", "1|1", "2|", "2 Rows retrieved"]
    assert list(Shell(engine, pretty=False, header=False).run("select k from null_logic where k > 9;")) == ["No Rows retrieved"]
    shell = Shell(engine)
    assert "Scan" in "\n".join(shell.run("set showplan on\nset noexec on\nselect k from null_logic;"))


def test_parse_trees():
    assert parse("select top 5 percent a, [b c] from t where a = 1") == N.Select(("a", "b c"), "t", N.Compare("=", N.Name("a"), N.Literal(1, "1")), 5, True)
    assert len(list(N.walk(parse("select * from t where a = 1 and not b is null").where))) == 7
