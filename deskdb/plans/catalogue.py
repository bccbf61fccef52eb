"""The registered queries of the engine, each beside the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb import metadata
from deskdb.catalog import QUERIES as QUERY_PARTS, Database
from deskdb.engine import Engine
from deskdb.functions.dates import from_serial, serial
from deskdb.functions.values import double_text
from deskdb.operators.change import appended, updated
from deskdb.render.ddl import USUAL, schema_lines
from deskdb.render.dialects import DEFAULTS, DROP, NOT_EMPTY
from deskdb.render.lines import delimited, inserts, json_lines, value_tuples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _statement(name: str, sql: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(spark, sf_dir).execute(sql)
    ORACLE[name] = oracle or sql


def _call(name: str, call: Callable[[Database], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: call(Database(spark, sf_dir))
    ORACLE[name] = oracle


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(columns: list[str], rows: list[tuple], kinds: list[str] | None = None) -> str:
    picked = [f'c{k}::{kinds[k]} AS "{c}"' if kinds else f'c{k} AS "{c}"' for k, c in enumerate(columns)]
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(picked)} FROM (VALUES {listed}) t({', '.join(f'c{k}' for k in range(len(columns)))})"


# -- selection
_statement(
    "flagship",
    "SELECT TOP 10 o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1-%' AND NOT ( o_totalprice > 100000.0 )",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1-%' AND NOT (o_totalprice > 100000.0) LIMIT 10",
)
_statement("scan_all", "SELECT * FROM nation")
_statement("project_case", "SELECT C_CUSTKEY, c_name FROM CUSTOMER", 'SELECT c_custkey AS "C_CUSTKEY", c_name FROM customer')
_statement("project_quoted", 'SELECT n_name, "n_regionkey", [n_nationkey] FROM "NATION"', "SELECT n_name, n_regionkey, n_nationkey FROM nation")
_statement("count_all", "SELECT COUNT(*) FROM orders", 'SELECT count(*) AS "count" FROM orders')
_statement("count_where", "SELECT COUNT(*) FROM orders WHERE o_totalprice < 100000.0", 'SELECT count(*) AS "count" FROM orders WHERE o_totalprice < 100000.0')
_statement("cmp_eq", "SELECT * FROM orders WHERE o_orderkey = 5")
_statement("cmp_neq", "SELECT * FROM nation WHERE n_regionkey <> 1")
_statement("cmp_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
_statement("cmp_mirror", "SELECT o_orderkey, o_totalprice FROM orders WHERE 50000 > o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000")
_statement(
    "cmp_text",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority >= '3' AND '4-NOT SPECIFIED' >= o_orderpriority",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority >= '3' AND o_orderpriority <= '4-NOT SPECIFIED'",
)
_statement("int_trunc", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3.7", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3")
_statement("like_case", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r_d%'")
_statement("ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'build%'")
_statement("is_null", "SELECT * FROM supplier WHERE s_name IS NULL")
_statement("not_null", "SELECT * FROM supplier WHERE s_name IS NOT NULL")
_statement("bool_tree", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT ( o_orderstatus = 'F' OR o_totalprice >= 50000 ) AND o_orderkey > 10")
_statement("not_prec", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_orderstatus = 'F' AND o_totalprice < 50000")
_statement("or_prec", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 AND n_nationkey > 10")
_statement("const_fold", "SELECT * FROM nation WHERE 1 = 1 AND n_regionkey = 2", "SELECT * FROM nation WHERE n_regionkey = 2")
_statement("const_trunc", "SELECT * FROM nation WHERE 3.9 = 3 AND 'abc' LIKE 'a%' AND n_regionkey = 2", "SELECT * FROM nation WHERE n_regionkey = 2")
_statement(
    "date_unix",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < 801964800",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < make_timestamp(801964800::BIGINT * 1000000)",
)
_statement(
    "date_strptime",
    "SELECT event_id, ts FROM events WHERE ts >= strptime('2024-01-15 00:00:00','%Y-%m-%d %H:%M:%S')",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
)
_statement(
    "date_days",
    "SELECT event_id, ts FROM events WHERE ts < 45310.25",
    "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '1899-12-30 00:00:00' + INTERVAL 45310 DAY + INTERVAL 6 HOUR",
)
_statement("date_braces", "SELECT event_id FROM events WHERE ts < {fn strptime('2024-01-02','%Y-%m-%d')}", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00'")

# -- limits
_statement("limit_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 LIMIT 50")
_statement("limit_negative", "SELECT n_name FROM nation LIMIT -1", "SELECT n_name FROM nation")
_statement("top_n", "SELECT TOP 7 o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, o_totalprice FROM orders LIMIT 7")
_statement(
    "top_percent",
    "SELECT TOP 3 PERCENT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT (SELECT CAST(trunc(count(*) / 100.0 * 3) AS BIGINT) FROM orders)",
)

# -- metadata
_TABLES = sorted("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
_DESCRIBED = ["Column Name", "Type", "Size"]
_statement("list_tables", "LIST TABLES", _values(["Tables"], [(t,) for t in _TABLES]))
_statement("describe", "DESCRIBE TABLE nation", _values(_DESCRIBED, [("n_nationkey", "Long Integer", "4"), ("n_name", "Text", "510"), ("n_regionkey", "Long Integer", "4")]))
_statement(
    "describe_orders",
    "DESCRIBE TABLE orders",
    _values(
        _DESCRIBED,
        [("o_orderkey", "Numeric", "17"), ("o_custkey", "Numeric", "17"), ("o_orderstatus", "Text", "510"), ("o_totalprice", "Double", "8"), ("o_orderdate", "DateTime", "8"), ("o_orderpriority", "Text", "510")],
    ),
)
_call("list_objects", lambda db: metadata.list_objects(db, "any"), _values(["name", "type", "object_type"], [(t, 1, "table") for t in _TABLES]))
_call("row_count", lambda db: db.table("part").agg(F.count(F.lit(1)).alias("n_rows")), "SELECT count(*) AS n_rows FROM part")
_call("odbc_tables", metadata.client_tables, _values(["TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME", "TABLE_TYPE", "REMARKS"], [(None, None, t, "TABLE", None) for t in _TABLES], ["VARCHAR"] * 5))
_CLIENT = [("n_nationkey", 4, "LONGINT"), ("n_name", 12, "TEXT"), ("n_regionkey", 4, "LONGINT")]
_call(
    "odbc_columns",
    lambda db: metadata.client_columns(db, "NATION"),
    _values(
        "TABLE_CAT TABLE_SCHEM TABLE_NAME COLUMN_NAME DATA_TYPE TYPE_NAME COLUMN_SIZE BUFFER_LENGTH DECIMAL_DIGITS NUM_PREC_RADIX NULLABLE REMARKS COLUMN_DEF SQL_DATA_TYPE SQL_DATETIME_SUB CHAR_OCTET_LENGTH ORDINAL_POSITION IS_NULLABLE".split(),
        [(None, None, "nation", n, c, t, None, None, None, None, 0, None, None, c, None, None, k + 1, None) for k, (n, c, t) in enumerate(_CLIENT)],
        "VARCHAR VARCHAR VARCHAR VARCHAR INT VARCHAR INT INT INT INT INT VARCHAR VARCHAR INT INT INT INT VARCHAR".split(),
    ),
)
_call(
    "odbc_types",
    metadata.client_types,
    _values(
        "TYPE_NAME DATA_TYPE COLUMN_SIZE LITERAL_PREFIX LITERAL_SUFFIX CREATE_PARAMS NULLABLE CASE_SENSITIVE SEARCHABLE UNSIGNED_ATTRIBUTE FIXED_PREC_SCALE AUTO_UNIQUE_VALUE LOCAL_TYPE_NAME MINIMUM_SCALE MAXIMUM_SCALE SQL_DATA_TYPE SQL_DATETIME_SUB NUM_PREC_RADIX INTERVAL_PRECISION".split(),
        [
            (n, c, z, None, None, None, 1, 1, 1, None, 0, a, None, 0, z, s, None, None, None)
            for n, c, z, a, s in [
                ("text", 12, 255, 0, 12), ("memo", 12, 4096, 0, 12), ("ole", 12, 16384, 0, 12), ("text", 1, 255, 0, 1), ("numeric", 2, 255, 0, 2), ("numeric", 3, 255, 0, 3),
                ("long integer", 4, 4, 1, 4), ("integer", 5, 4, 1, 5), ("integer", 5, 4, 1, 5), ("single", 7, 4, 1, 7), ("double", 8, 8, 1, 6), ("datetime", 9, 8, 1, 9),
            ]
        ],
        "VARCHAR INT INT VARCHAR VARCHAR VARCHAR INT INT INT INT INT INT VARCHAR INT INT INT INT INT INT".split(),
    ),
)


def _stored(db: Database) -> DataFrame:
    a, b = b"\x00", b"\x01"
    rows = [
        (1, 3, None, 0x10, "5", None, a), (1, 5, None, 0, "Orders", None, a), (1, 6, "OrderID", 0, None, None, a), (1, 6, "ShipName", 0, None, None, b),
        (1, 8, "ShipName Like 'A*'", 0, None, None, a), (1, 11, "ShipName", 0, "D", None, a), (1, 11, "OrderID", 0, "", None, b),
        (2, 3, None, 0x30, "10", None, a), (2, 5, None, 0, "a", None, a), (2, 5, None, 0, "b", None, b), (2, 6, "a.x", 0, None, None, a), (2, 7, "a.x = b.x", 1, "a", "b", a),
        (3, 3, None, 0x2, None, None, a), (3, 5, None, 0, "t", None, a), (3, 6, "c", 0, None, None, a),
    ]
    return metadata.query_texts(db.spark.createDataFrame(rows, QUERY_PARTS))


_call(
    "stored_query_sql",
    _stored,
    _values(
        ["object_id", "sql"],
        [(1, "SELECT TOP 5 OrderID,ShipName FROM [Orders] WHERE ShipName Like 'A*' ORDER BY ShipName DESCENDING"), (2, "SELECT TOP 10 PERCENT a.x FROM [a],[b] "), (3, "SELECT DISTINCT c FROM [t] ")],
        ["INT", "VARCHAR"],
    ),
)

# -- values
_call(
    "date_serial",
    lambda db: db.table("orders").select("o_orderkey", F.round(serial(F.col("o_orderdate")), 6).alias("serial"), from_serial(serial(F.col("o_orderdate"))).alias("back")),
    "SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0 + 25569, 6) AS serial, o_orderdate AS back FROM orders",
)
_call(
    "double_text",
    lambda db: db.table("lineitem").select("l_orderkey", "l_linenumber", double_text("l_quantity").alias("quantity"), double_text(F.col("l_quantity") / 7).alias("seventh")),
    "SELECT l_orderkey, l_linenumber, printf('%.16g', l_quantity) AS quantity, printf('%.16g', l_quantity / 7) AS seventh FROM lineitem",
)

# -- output
_call(
    "csv_lines",
    lambda db: delimited(db.table("supplier").select("s_suppkey", "s_name", "s_nationkey")),
    """SELECT s_suppkey || ',"' || replace(s_name, '"', '""') || '",' || s_nationkey AS line FROM supplier""",
)
_call(
    "json_lines",
    lambda db: json_lines(db.table("nation")),
    """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""",
)
_call(
    "insert_tuples",
    lambda db: value_tuples(db.table("nation"), "postgres"),
    "SELECT '(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')' AS line FROM nation",
)
_call(
    "insert_batches",
    lambda db: inserts(db.table("nation", storage_order=True), "nation", "postgres", batch=10),
    """WITH t AS (SELECT row_number() OVER () - 1 AS n, '(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')' AS tuple FROM nation)
    SELECT n // 10 AS statement_no, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES ' || string_agg(tuple, ', ' ORDER BY n) || ';' AS line FROM t GROUP BY 1""",
)
_call(
    "insert_single",
    lambda db: inserts(db.table("region", storage_order=True), "region", "oracle").select("line"),
    """SELECT 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', "' || r_name || '");' AS line FROM region""",
)


def _ddl(name: str, columns: list[str], opening: list[str], rest: list[str], options=USUAL) -> None:
    def run(db: Database) -> DataFrame:
        return db.spark.createDataFrame(list(enumerate(schema_lines(db, name, "nation", options=options))), "n int, line string")

    charset = "SET client_encoding = 'UTF-8';" if name == "postgres" else "-- That file uses encoding UTF-8"
    lines = ["-- Schema written by deskdb", "", charset, "", *opening, *[c + ", " for c in columns[:-1]], columns[-1], ");", "", *rest]
    _call(f"ddl_{name}", run, _values(["n", "line"], list(enumerate(lines)), ["INT", "VARCHAR"]))


def _columns(before: str, after: str, kinds: list[str]) -> list[str]:
    return [f"\t{before}{n}{after}\t\t\t{t}" for n, t in zip(("n_nationkey", "n_name", "n_regionkey"), kinds)]


_INDEXES, _RELATIONS = ["-- CREATE INDEXES ...", ""], ["", "-- CREATE Relationships ..."]
_ddl("access", _columns("[", "]", ["Long Integer", "Text (255)", "Long Integer"]), ["CREATE TABLE [nation]", " ("], [""])
_ddl("sybase", _columns('"', '"', ["int", "nvarchar (255)", "int"]), ['CREATE TABLE "nation"', " ("], [""])
_ddl("oracle", _columns('"', '"', ["NUMBER(11)", "VARCHAR2 (255)", "NUMBER(11)"]), ['CREATE TABLE "nation"', " ("], [*_INDEXES, *_RELATIONS])
_ddl(
    "postgres",
    _columns('"', '"', ["INTEGER", "VARCHAR (255)", "INTEGER"]),
    ['DROP TABLE IF EXISTS "nation";', 'CREATE TABLE IF NOT EXISTS "nation"', " ("],
    [*_INDEXES, *_RELATIONS],
    USUAL | {DROP, DEFAULTS, NOT_EMPTY},
)
_ddl("mysql", _columns("`", "`", ["int", "varchar (255)", "int"]), ["CREATE TABLE `nation`", " ("], [*_INDEXES, *_RELATIONS])
_ddl("sqlite", _columns("`", "`", ["INTEGER", "varchar", "INTEGER"]), ["CREATE TABLE `nation`", " ("], [*_INDEXES, ""])

# -- changes
_call(
    "csv_append",
    lambda db: appended(db.table("region"), db.spark.createDataFrame([(99, "NOWHERE")], "R_REGIONKEY int, r_name string")),
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'",
)
_call(
    "update_where",
    lambda db: updated(db.table("nation"), {"N_NAME": "CHANGED", "n_regionkey": None}, "n_regionkey = 2 AND NOT n_name LIKE 'C%'"),
    """SELECT n_nationkey, CASE WHEN n_regionkey = 2 AND n_name NOT LIKE 'C%' THEN 'CHANGED' ELSE n_name END AS n_name,
    CASE WHEN n_regionkey = 2 AND n_name NOT LIKE 'C%' THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation""",
)
