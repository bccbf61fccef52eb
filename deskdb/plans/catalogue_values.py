"""Registered queries over values, predicates, output and sessions that the plain tables alone don't reach: nulls, quotes, fractions, binaries, money."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from deskdb import metadata
from deskdb.catalog import Database
from deskdb.engine import Engine, connection
from deskdb.errors import DeskError
from deskdb.functions.values import Style, rendered
from deskdb.operators.ingest import read_csv
from deskdb.plans.catalogue import _call, _values
from deskdb.plans.shell import Shell
from deskdb.render.boxes import boxes, plain, retrieved
from deskdb.render.ddl import schema_lines
from deskdb.render.lines import Delimited, delimited, json_lines, value_tuples, write_delimited
from deskdb.scratch import scratch_path
from deskdb.sql import nodes as N
from deskdb.sql.parser import parse


def _lines(db: Database, lines) -> DataFrame:
    return db.spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def _listed(lines: list[str]) -> str:
    return _values(["n", "line"], list(enumerate(lines)), ["INT", "VARCHAR"])


def _texts(df: DataFrame, key: str, style: Style = Style()) -> DataFrame:
    """``key``, and every other column as its text."""
    return df.select(key, *[rendered(f, style).alias(f.name) for f in df.schema if f.name != key])


def _on(name: str, made, sql: str, oracle: str) -> None:
    """A statement over a table ``t`` that is made of the database's."""
    _call(name, lambda db: Engine(db.spark, Database(db.spark, tables={"t": made(db)})).execute(sql), oracle)


# -- values as text
_call(
    "money_text",
    lambda db: _texts(db.table("supplier").select("s_suppkey", (F.col("s_acctbal") - 5000).cast("decimal(19,4)").alias("cash"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal").cast("decimal(19,4)")).alias("some")), "s_suppkey"),
    "SELECT s_suppkey, CAST(CAST(s_acctbal - 5000 AS DECIMAL(19,4)) AS VARCHAR) AS cash, CASE WHEN s_suppkey % 3 > 0 THEN CAST(CAST(s_acctbal AS DECIMAL(19,4)) AS VARCHAR) END AS some FROM supplier",
)
_call(
    "numeric_text",
    lambda db: _texts(db.table("customer").select("c_custkey", (-F.col("c_acctbal")).cast("decimal(18,3)").alias("a"), F.col("c_acctbal").cast("decimal(12,0)").alias("b"), (F.col("c_custkey").cast("decimal(9,0)") / 1000).cast("decimal(9,3)").alias("c")), "c_custkey"),
    "SELECT c_custkey, CAST(CAST(-c_acctbal AS DECIMAL(18,3)) AS VARCHAR) AS a, CAST(CAST(c_acctbal AS DECIMAL(12,0)) AS VARCHAR) AS b, (c_custkey // 1000) || '.' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS c FROM customer",
)
_call(
    "double_fractions",
    lambda db: _texts(db.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_extendedprice", (F.col("l_discount") / 3).alias("third"), (F.col("l_extendedprice") * 1e12).alias("large"), (F.col("l_tax") / 1e9).alias("small"), F.when(F.col("l_quantity") > 25, -F.col("l_quantity")).alias("some")), "k"),
    """SELECT l_orderkey || '-' || l_linenumber AS k, printf('%.16g', l_extendedprice) AS l_extendedprice, printf('%.16g', l_discount / 3) AS third, printf('%.16g', l_extendedprice * 1e12) AS large, printf('%.16g', l_tax / 1e9) AS small,
    CASE WHEN l_quantity > 25 THEN printf('%.16g', -l_quantity) END AS some FROM lineitem""",
)
_call(
    "single_text",
    lambda db: _texts(db.table("part").select("p_partkey", F.col("p_retailprice").cast("float").alias("price"), (F.col("p_size").cast("float") / F.lit(7).cast("float")).cast("float").alias("seventh")), "p_partkey"),
    "SELECT p_partkey, printf('%.8g', p_retailprice::FLOAT::DOUBLE) AS price, printf('%.8g', (p_size::FLOAT / 7::FLOAT)::DOUBLE) AS seventh FROM part",
)
_call(
    "date_text",
    lambda db: _texts(db.table("events").select("event_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("some")), "event_id"),
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS some FROM events",
)
_call(
    "date_formats",
    lambda db: _texts(db.table("orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day")), "o_orderkey", Style("%d/%m/%y %H.%M 100%%", "%B %d, %Y (%a)")),
    "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y %H.%M 100%%') AS o_orderdate, strftime(o_orderdate, '%B %d, %Y (%a)') AS day FROM orders",
)
_GUIDS = lambda db: db.table("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 > 0, F.unhex(F.md5(F.col("s_name").cast("binary")))).alias("id", metadata={"kind": "Replication ID"}))
_GUID_SQL = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN {0} END AS id FROM (SELECT s_suppkey, md5(s_name) AS h FROM supplier)"
_GUID_HEAD = "upper(h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || {0} || h[21:32])"
_call("guid_text", lambda db: _texts(_GUIDS(db), "s_suppkey"), _GUID_SQL.format(_GUID_HEAD.format("'-'")))
_call("guid_braces", lambda db: _texts(_GUIDS(db), "s_suppkey", Style(braces=True)), _GUID_SQL.format("'{' || " + _GUID_HEAD.format("''") + " || '}'"))
_FLAGS = lambda db: db.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 > 0, F.col("n_regionkey") > 1).alias("flag"))
_call("bool_text", lambda db: _texts(_FLAGS(db), "n_nationkey"), "SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 AND n_regionkey > 1 THEN '1' ELSE '0' END AS flag FROM nation")
_call("bool_words", lambda db: _texts(_FLAGS(db), "n_nationkey", Style(words=True)), "SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 AND n_regionkey > 1 THEN 'TRUE' ELSE 'FALSE' END AS flag FROM nation")

# -- predicates of other types
_on(
    "decimal_predicate",
    lambda db: db.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal").cast("decimal(19,4)")).alias("cash"), F.col("c_acctbal").cast("decimal(18,3)").alias("num")),
    "SELECT c_custkey FROM t WHERE cash >= 1000.5 AND NOT num > 5000.25 OR cash < -900 OR cash = 0",
    """SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal::DECIMAL(19,4) END AS cash, c_acctbal::DECIMAL(18,3) AS num FROM customer)
    WHERE cash >= 1000.5 AND NOT num > 5000.25 OR cash < -900 OR cash = 0""",
)
_on("binary_predicate", lambda db: db.table("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name").cast("binary")).alias("raw")), "SELECT s_suppkey FROM t WHERE raw IS NOT NULL", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0")
_on("bool_predicate", _FLAGS, "SELECT n_nationkey FROM t WHERE flag = 1 AND n_nationkey <> 4", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 > 0 AND n_regionkey > 1 AND n_nationkey <> 4")
_on(
    "memo_predicate",
    lambda db: db.table("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 > 0, F.col("text")).alias("body", metadata={"kind": "Memo/Hyperlink"})),
    "SELECT conv_id, turn FROM t WHERE body LIKE '%e%' AND body > 'M' OR body IS NULL",
    "SELECT conv_id, turn FROM conversations WHERE turn % 4 > 0 AND text LIKE '%e%' AND text > 'M' OR NOT turn % 4 > 0",
)
_on(
    "repid_predicate",
    lambda db: db.table("nation").select("n_nationkey", F.md5(F.col("n_name").cast("binary")).alias("id", metadata={"kind": "Replication ID"})),
    "SELECT n_nationkey FROM t WHERE id >= '8' AND NOT id LIKE '%f'",
    "SELECT n_nationkey FROM nation WHERE md5(n_name) >= '8' AND md5(n_name) NOT LIKE '%f'",
)
_on("null_rows", lambda db: db.table("part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("name")), "SELECT * FROM t WHERE name IS NULL OR name LIKE 'b%'", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS name FROM part WHERE NOT p_size % 3 > 0 OR p_name LIKE 'b%'")
_call("keyword_case", lambda db: Engine(db.spark, db).execute("sElEcT n_name fRoM NATION wHeRe n_regionkey = 1 aNd nOt n_name LiKe 'A%' lImIt 3"), "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_name NOT LIKE 'A%' LIMIT 3")
_call("bracket_braces", lambda db: Engine(db.spark, Database(db.spark, tables={"t": db.table("nation").select(F.col("n_name").alias("a {b}"))})).execute("SELECT [a {b}] FROM t WHERE [a {b}] > {fn 'J'}"), 'SELECT n_name AS "a {b}" FROM nation WHERE n_name > \'J\'')
_call("tree_walk", lambda db: _lines(db, (type(x).__name__ for x in N.walk(parse("SELECT a FROM t WHERE NOT (a = 1 OR b IS NULL) AND c LIKE 'x%'").where))), _listed(["And", "Not", "Or", "Compare", "Name", "Literal", "IsNull", "Name", "Compare", "Name", "Literal"]))


# -- delimited lines, JSON, INSERT
def _pages(db: Database) -> DataFrame:
    return db.table("pages").select("page_id", F.when(F.col("page_id") % 5 > 0, F.when(F.col("page_id") % 7 > 0, F.col("html")).otherwise("")).alias("html"), F.when(F.col("page_id") % 3 > 0, F.col("page_id") / 8).alias("share"))


_PAGES_SQL = "(SELECT page_id, CASE WHEN page_id % 5 > 0 THEN CASE WHEN page_id % 7 > 0 THEN html ELSE '' END END AS html, CASE WHEN page_id % 3 > 0 THEN printf('%.16g', page_id / 8) END AS share FROM pages)"
_call("csv_quotes", lambda db: delimited(_pages(db)), f"""SELECT page_id || ',' || CASE WHEN html <> '' THEN '"' || replace(html, '"', '""') || '"' ELSE '' END || ',' || coalesce(share, '') AS line FROM {_PAGES_SQL}""")
_call(
    "csv_options",
    lambda db: delimited(_pages(db), Delimited(";", quote="'", escape="\\", escape_invisible=True, null="(none)")),
    f"""SELECT page_id || ';' || CASE WHEN html <> '' THEN '''' || replace(replace(replace(replace(replace(html, '\\', '\\\\'), '''', '\\'''), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') || '''' ELSE '(none)' END || ';' || coalesce(share, '(none)') AS line FROM {_PAGES_SQL}""",
)
_call("csv_no_quotes", lambda db: delimited(_pages(db), Delimited("|", quoting=False)), f"SELECT page_id || '|' || coalesce(html, '') || '|' || coalesce(share, '') AS line FROM {_PAGES_SQL}")
_RAW = lambda db: db.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name").cast("binary")).alias("raw"))
_OCTAL = """list_aggregate(list_transform(range(1, length(n_name) + 1), lambda i: '\\' || printf('%03o', ascii(substr(n_name, i, 1)))), 'string_agg', '')"""
for _mode, _shown in (("raw", """'"' || n_name || '"'"""), ("strip", """'""'"""), ("hex", "'\"' || hex(encode(n_name)) || '\"'"), ("octal", f"'\"' || {_OCTAL} || '\"'")):
    _call(f"binary_{_mode}", lambda db, m=_mode: delimited(_RAW(db), Delimited(style=Style(binary=m))), f"SELECT n_nationkey || ',' || CASE WHEN n_nationkey % 4 > 0 THEN {_shown} ELSE '' END AS line FROM nation")
_JSON_TEXT = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\u000a'), chr(9), '\\u0009'), chr(13), '\\u000d')"
_call(
    "json_nulls",
    lambda db: json_lines(_pages(db).withColumn("flag", F.col("page_id") % 2 == 0).withColumn("raw", F.when(F.col("page_id") % 3 > 0, F.encode(F.col("page_id").cast("string"), "UTF-8")))),
    f"""SELECT '{{"page_id":' || page_id || CASE WHEN html <> '' THEN ',"html":"' || {_JSON_TEXT.format('html')} || '"' ELSE '' END || CASE WHEN share IS NOT NULL THEN ',"share":' || share ELSE '' END
    || ',"flag":' || (page_id % 2 = 0)::INT || CASE WHEN page_id % 3 > 0 THEN ',"raw":{{"$binary": "' || to_base64(encode(page_id::VARCHAR)) || '", "$type": "00"}}' ELSE '' END || '}}' AS line FROM {_PAGES_SQL}""",
)
_call(
    "json_blank_controls",
    lambda db: json_lines(_pages(db).select("page_id", "html"), blank_controls=True),
    f"""SELECT '{{"page_id":' || page_id || CASE WHEN html <> '' THEN ',"html":"' || regexp_replace(replace(replace(html, '\\', '\\\\'), '"', '\\"'), '[\\x00-\\x1f]', ' ', 'g') || '"' ELSE '' END || '}}' AS line FROM {_PAGES_SQL}""",
)
_call(
    "insert_quotes",
    lambda db: value_tuples(_pages(db), "postgres"),
    f"""SELECT '(' || page_id || ', ' || CASE WHEN html <> '' THEN '''' || replace(html, '''', '''''') || '''' ELSE 'NULL' END || ', ' || coalesce(share, 'NULL') || ')' AS line FROM {_PAGES_SQL}""",
)


def _csv_import(db: Database) -> DataFrame:
    """Written as delimited files with a header each, and read again."""
    path = scratch_path(db.spark, "csv")
    made = db.table("supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.when(F.col("s_suppkey") % 6 > 0, F.concat(F.lit('a "'), "s_name", F.lit(', b"'))).alias("name"), (F.col("s_nationkey") > 10).alias("far"), F.when(F.col("s_suppkey") % 4 > 0, -F.col("s_nationkey")).alias("n"))
    write_delimited(made, path)
    return read_csv(db.spark, path, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("far", T.BooleanType()), T.StructField("n", T.IntegerType())]), skip=1)


_call("csv_import", _csv_import, """SELECT s_suppkey::INT AS k, CASE WHEN s_suppkey % 6 > 0 THEN 'a "' || s_name || ', b"' END AS name, s_nationkey > 10 AS far, CASE WHEN s_suppkey % 4 > 0 THEN -s_nationkey END AS n FROM supplier""")

# -- boxes and shells
_SHOWN = "SELECT row_number() OVER () AS r, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"
_call(
    "box_lines",
    lambda db: _lines(db, boxes(Engine(db.spark, db).execute("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1"))),
    f"""WITH s AS ({_SHOWN}), c AS (SELECT count(*)::INT AS c FROM s), rule AS (SELECT '+' || repeat('-', 255) || '+' || repeat('-', 11) || '+' AS x)
    SELECT 0 AS n, x AS line FROM rule UNION ALL SELECT 1, '|' || rpad('n_name', 255, ' ') || '|n_regionkey|' UNION ALL SELECT 2, x FROM rule
    UNION ALL SELECT 2 + r::INT, '|' || rpad(n_name, 255, ' ') || '|' || rpad(n_regionkey::VARCHAR, 11, ' ') || '|' FROM s UNION ALL SELECT 3 + c, x FROM c, rule UNION ALL SELECT 4 + c, c || ' Rows retrieved' FROM c""",
)
_call(
    "plain_lines",
    lambda db: _lines(db, plain(Engine(db.spark, db).execute("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1"), "::")),
    f"WITH s AS ({_SHOWN}) SELECT 0 AS n, 'n_name::n_regionkey' AS line UNION ALL SELECT r::INT, n_name || '::' || n_regionkey FROM s UNION ALL SELECT 1 + count(*)::INT, count(*) || ' Rows retrieved' FROM s",
)
_call("footers", lambda db: _lines(db, [retrieved(n) for n in (0, 1, 2, 250)]), _listed(["No Rows retrieved", "1 Row retrieved", "2 Rows retrieved", "250 Rows retrieved"]))
_SCRIPT = """SELECT r_name FROM region WHERE r_regionkey = 1;
go
set noexec on
SELECT r_name FROM region
go
set noexec off
SELECT nothing FROM
reset
LIST TABLES no;
SELECT COUNT(*) FROM nation;
exit
SELECT r_name FROM region"""


def _shell(db: Database) -> DataFrame:
    lines = [x.split(":")[0] if x.startswith("Error") else x for x in Shell(Engine(db.spark, db), pretty=False).run(_SCRIPT)]
    return _lines(db, lines)


_call("shell_script", _shell, "SELECT 0 AS n, 'r_name' AS line UNION ALL SELECT 1, r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 2, '1 Row retrieved' UNION ALL SELECT 3, 'Error' UNION ALL SELECT 4, 'count' UNION ALL SELECT 5, count(*)::VARCHAR FROM nation UNION ALL SELECT 6, '1 Row retrieved'")


# -- sessions
def _session(db: Database) -> DataFrame:
    """What a session says, step by step."""
    engine, out = Engine(db.spark, sources={"shop": db}), []
    for sql in ("SELECT COUNT(*) FROM region", "CONNECT TO shop", "SELECT COUNT(*) FROM region", "DISCONNECT", "DISCONNECT", "CONNECT TO 'no such place'", f"CONNECT TO '{db.path}'", "SELECT COUNT(*) FROM nation"):
        try:
            got = engine.execute(sql)
            out.append(str(got.head()[0]) if got.columns == ["count"] else "done")
        except DeskError as e:
            out.append(type(e).__name__)
    return _lines(db, out)


_call("connect_disconnect", _session, "SELECT * FROM (VALUES (0, 'NotConnected'), (1, 'done'), (3, 'done'), (4, 'NotConnected'), (5, 'AnalysisError'), (6, 'done')) t(n, line) UNION ALL SELECT 2, count(*)::VARCHAR FROM region UNION ALL SELECT 7, count(*)::VARCHAR FROM nation")
_BAD = ["SELEC x FROM t", "SELECT FROM nation", "SELECT n_name FROM nation WHERE", "SELECT n_name FROM nation WHERE n_name ~ 'a'", "SELECT TOP 5 n_name FROM nation LIMIT 3", "SELECT TOP 101 PERCENT n_name FROM nation", "SELECT n_name FROM nation WHERE (n_name = 'a'", "SELECT n_name FROM nation extra", "SELECT n_name FROM nowhere", "SELECT nothing FROM nation", "SELECT n_name FROM nation WHERE n_name > 5"]


def _errors(statements: list[str]):
    def run(db: Database) -> DataFrame:
        out = []
        for sql in statements:
            try:
                Engine(db.spark, db).execute(sql).count()
                out.append("none")
            except DeskError as e:
                out.append(type(e).__name__)
        return _lines(db, out)

    return run


_call("parse_errors", _errors(_BAD[:8]), _listed(["ParseError"] * 8))
_call("analysis_errors", _errors(_BAD[8:]), _listed(["AnalysisError"] * 3))
_call("top_with_limit", _errors(["SELECT TOP 2 n_name FROM nation LIMIT 2", "SELECT TOP 2 n_name FROM nation", "SELECT n_name FROM nation LIMIT 2"]), _listed(["ParseError", "none", "none"]))


def _cursor(db: Database) -> DataFrame:
    c = Engine(db.spark, db).cursor().prepare("SELECT n_nationkey, n_name FROM nation LIMIT 6")
    c.execute()
    got = [("one", c.fetchone()), *(("many", r) for r in c.fetchmany(2))]
    c.rewind()
    got += [("again", r) for r in c] + [("end", (None, str(c.fetchone())))]
    return db.spark.createDataFrame([(k, how, r[0], r[1]) for k, (how, r) in enumerate(got)], "n int, how string, n_nationkey int, n_name string")


_call(
    "cursor_rewind",
    _cursor,
    """WITH s AS (SELECT row_number() OVER () AS r, n_nationkey, n_name FROM nation LIMIT 6) SELECT r::INT - 1 AS n, CASE r WHEN 1 THEN 'one' ELSE 'many' END AS how, n_nationkey, n_name FROM s WHERE r <= 3
    UNION ALL SELECT 2 + r::INT, 'again', n_nationkey, n_name FROM s UNION ALL SELECT 9, 'end', NULL, 'None'""",
)


def _prepared(db: Database) -> DataFrame:
    """One statement, executed twice; the second run's rows."""
    c = Engine(db.spark, db).cursor().prepare("SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
    c.execute().fetchall()
    return db.spark.createDataFrame(c.execute().fetchall(), "r_regionkey int, r_name string")


_call("prepared_twice", _prepared, "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
_DSN = ["DBQ=/data/a.mdb;UID=x", "dsn=shop; Database={a;b}", "Driver={Desk};DBQ= /p q/r ;", ""]
_call("connection_strings", lambda db: _lines(db, [";".join(f"{k}={v}" for k, v in sorted(connection(x).items())) for x in _DSN]), _listed(["dbq=/data/a.mdb;uid=x", "database=a;b;dsn=shop", "dbq=/p q/r;driver=Desk", ""]))


def _plan(db: Database) -> DataFrame:
    text = Engine(db.spark, db).explain("SELECT o_orderkey FROM orders WHERE o_totalprice < 1000.0")
    return _lines(db, [str(x) for x in ("Scan parquet" in text, "PushedFilters: [IsNotNull(o_totalprice), LessThan(o_totalprice,1000.0)]" in text, "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text, "Exchange" in text)])


_call("plan_display", _plan, _listed(["True", "True", "True", "False"]))
_call(
    "result_metadata",
    lambda db: db.spark.createDataFrame(Engine(db.spark, db).cursor().execute("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders").description, "name string, type string, width int, size int, precision int, scale int, nullable boolean"),
    _values(["name", "type", "width", "size", "precision", "scale", "nullable"], [("o_orderkey", "Numeric", 20, 17, 19, 0, True), ("o_orderstatus", "Text", 255, 510, 0, 0, True), ("o_totalprice", "Double", 10, 8, 0, 0, True), ("o_orderdate", "DateTime", 20, 8, 0, 0, True)], ["VARCHAR", "VARCHAR", "INT", "INT", "INT", "INT", "BOOLEAN"]).replace("True", "TRUE"),
)
_CASTS = [("12.9", "integer"), (-12.9, "integer"), (300, "utinyint"), (255, "utinyint"), (-1, "usmallint"), ("x", "bigint"), (1, "bit"), (2, "bit"), ("1.5", "double"), ("2.50", "numeric"), (None, "integer"), (7, "char"), (b"\x01", "integer"), (2**31, "integer"), (2**31, "uinteger")]


def _conversions(db: Database) -> DataFrame:
    out = []
    for value, to in _CASTS:
        try:
            out.append(str(metadata.convert(value, to)))
        except DeskError as e:
            out.append(type(e).__name__)
    return _lines(db, out)


_call("conversions", _conversions, _listed(["12", "-12", "OutOfRange", "255", "OutOfRange", "NotImplementedType", "1", "OutOfRange", "1.5", "2.50", "None", "7", "NotImplementedType", "OutOfRange", "2147483648"]))


def _values_by_type(db: Database) -> DataFrame:
    """Two columns of the first rows, fetched as a client binds them: a whole number and a text."""
    c = Engine(db.spark, db).cursor().execute("SELECT n_nationkey, n_name FROM nation LIMIT 4")
    return db.spark.createDataFrame([(c.get(r, 1, "integer"), c.get(r, 1, "char"), c.get(r, 2, "char"), c.get(r, 2, "binary")) for r in c], "a int, b string, c string, d binary")


_call("bound_columns", _values_by_type, "SELECT n_nationkey AS a, n_nationkey::VARCHAR AS b, n_name AS c, encode(n_name) AS d FROM nation LIMIT 4")


# -- metadata with side tables
def _with_side(db: Database) -> Database:
    s = db.spark
    from deskdb import catalog as C

    return Database(
        s,
        tables={"nation": db.table("nation"), "region": db.table("region")},
        side={
            "objects": s.createDataFrame([(1, "nation", 1, 0, {}), (2, "region", 1, 0, {}), (3, "MSysObjects", 1, 0x80000000, {}), (4, "by region", 5, 0, {}), (5, "first", 5, 0, {}), (6, "a form", 0, 0, {})], C.OBJECTS),
            "indexes": s.createDataFrame([("nation", "PrimaryKey", 1, 1, [("n_nationkey", False)]), ("nation", "by name", 0, 0, [("n_name", True), ("n_regionkey", False)]), ("nation", "fk", 2, 0, [("n_regionkey", False)]), ("nation", "one", 0, 1, [("n_name", False)]), ("nation", "none", 0, 0, [])], C.INDEXES),
            "relationships": s.createDataFrame([("n_regionkey", "nation", "r_regionkey", "region", 0x1100), ("n_name", "nation", "r_name", "region", 2)], C.RELATIONSHIPS),
            "properties": s.createDataFrame([("nation", None, "Description", "All 'nations'"), ("nation", "n_name", "Required", "yes"), ("nation", "n_name", "DefaultValue", '"none"'), ("region", None, "Description", "x")], C.PROPERTIES),
            "queries": s.createDataFrame([(4, 5, None, 0, "nation", None, b"\0"), (4, 6, "n_name", 0, None, None, b"\0")], C.QUERIES),
        },
    )


_call("properties", lambda db: metadata.properties(_with_side(db), "NATION"), _values(["column", "name", "value"], [(None, "Description", "All 'nations'"), ("n_name", "Required", "yes"), ("n_name", "DefaultValue", '"none"')], ["VARCHAR"] * 3))
_call("stored_queries", lambda db: metadata.stored_queries(_with_side(db)), _values(["name"], [("by region",), ("first",)]))
_call("stored_query", lambda db: _lines(db, [metadata.stored_query(_with_side(db), "by region")]), _listed(["SELECT n_name FROM [nation] "]))
_call("user_tables", lambda db: metadata.list_tables(_with_side(db)), _values(["Tables"], [("nation",), ("region",)]))
_call("system_tables", lambda db: metadata.list_objects(_with_side(db), "systable"), _values(["name", "type", "object_type"], [("MSysObjects", 1, "table")]))


def _ddl(name: str, lines: list[str], dialect: str, wanted: set[str]) -> None:
    _call(name, lambda db: _lines(db, schema_lines(_with_side(db), dialect, "nation", options=wanted, charset=None)), _listed(["-- Schema written by deskdb", "", *lines]))


_ddl(
    "ddl_indexes",
    ['CREATE TABLE IF NOT EXISTS "nation"', " (", '\t"n_nationkey"\t\t\tINTEGER, ', '\t"n_name"\t\t\tVARCHAR (255), ', '\t"n_regionkey"\t\t\tINTEGER', ");", "", "-- CREATE INDEXES ...",
     'ALTER TABLE "nation" ADD CONSTRAINT "nation_pkey" PRIMARY KEY ("n_nationkey");', 'CREATE INDEX "nation_by name_idx" ON "nation" ("n_name" DESC, "n_regionkey");', '-- WARNING: found no keys for index "nation_none_idx" - ignored', 'CREATE UNIQUE INDEX "nation_one_idx" ON "nation" ("n_name");', "", ""],
    "postgres", {"indexes"},
)
_ddl(
    "ddl_indexes_mysql",
    ["CREATE TABLE `nation`", " (", "\t`n_nationkey`\t\t\tint, ", "\t`n_name`\t\t\tvarchar (255), ", "\t`n_regionkey`\t\t\tint", ");", "", "-- CREATE INDEXES ...",
     "ALTER TABLE `nation` ADD PRIMARY KEY (`n_nationkey`);", "ALTER TABLE `nation` ADD INDEX `by name` (`n_name` DESC, `n_regionkey`);", "-- WARNING: found no keys for index `none` - ignored", "ALTER TABLE `nation` ADD UNIQUE INDEX `one` (`n_name`);", "", ""],
    "mysql", {"indexes"},
)
_ddl(
    "ddl_relationships",
    ['CREATE TABLE IF NOT EXISTS "nation"', " (", '\t"n_nationkey"\t\t\tINTEGER, ', '\t"n_name"\t\t\tVARCHAR (255) NOT NULL DEFAULT \'none\', ', '\t"n_regionkey"\t\t\tINTEGER', ");", 'COMMENT ON TABLE "nation" IS \'All \'\'nations\'\'\';', "", "", "-- CREATE Relationships ...",
     'ALTER TABLE "nation" ADD CONSTRAINT "nation_n_regionkey_fk" FOREIGN KEY ("n_regionkey") REFERENCES "region"("r_regionkey") ON UPDATE CASCADE ON DELETE CASCADE DEFERRABLE INITIALLY IMMEDIATE;',
     '-- Relationship from "nation" ("n_name") to "region"("r_name") does not enforce integrity.'],
    "postgres", {"relations", "not null", "defaults", "comments"},
)
