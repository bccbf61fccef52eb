"""The command line: ``python -m deskdb COMMAND DATABASE ...``. A database is a folder of Parquet tables or a page file."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from deskdb import metadata
from deskdb.catalog import OBJECT_TYPES, Database
from deskdb.engine import Engine
from deskdb.errors import DeskError
from deskdb.functions.values import BINARY_MODES, Style
from deskdb.operators.ingest import import_csv
from deskdb.plans.shell import Shell
from deskdb.render import dialects as D
from deskdb.render.ddl import USUAL, schema_lines
from deskdb.render.lines import Delimited, delimited, header_line, inserts, json_lines, unescaped, write_delimited, write_inserts, write_json


def open_database(spark: SparkSession, path: str) -> Database:
    if path.lower().endswith((".mdb", ".accdb", ".mde", ".accde")):
        from deskdb.sources.pagefile import database

        return database(spark, path)
    return Database(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("deskdb", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for x in ("database", *positional):
            c.add_argument(x)
        return c

    c = command("sql", "run statements from standard input")
    c.add_argument("-P", "--plain", action="store_true", help="no boxes")
    c.add_argument("-d", "--delimiter", default="\t")
    c.add_argument("-H", "--no-header", action="store_true")
    c.add_argument("-F", "--no-footer", action="store_true")
    c.add_argument("-i", "--input", help="a file of statements instead of standard input")
    c.add_argument("-o", "--output", help="a file for the results instead of standard output")
    c = command("tables", "list objects")
    c.add_argument("-S", "--system", action="store_true")
    c.add_argument("-1", "--single", action="store_true", help="one on a line")
    c.add_argument("-d", "--delimiter", default=" ")
    c.add_argument("-t", "--type", default="table", choices=[*OBJECT_TYPES.values(), "any", "all"])
    c.add_argument("-T", "--show-type", action="store_true")
    c = command("export", "rows as delimited lines or INSERT statements", "table")
    c.add_argument("-H", "--no-header", action="store_true")
    c.add_argument("-d", "--delimiter", default=",")
    c.add_argument("-R", "--row-delimiter", default="\n")
    c.add_argument("-Q", "--no-quote", action="store_true")
    c.add_argument("-q", "--quote")
    c.add_argument("-X", "--escape")
    c.add_argument("-e", "--escape-invisible", action="store_true")
    c.add_argument("-I", "--insert", choices=list(D.DIALECTS))
    c.add_argument("-S", "--batch-size", type=int, default=1000)
    c.add_argument("-N", "--namespace")
    c.add_argument("-0", "--null", default="")
    c.add_argument("-B", "--boolean-words", action="store_true")
    c.add_argument("-D", "--date-format")
    c.add_argument("-T", "--datetime-format")
    c.add_argument("-b", "--bin", default="raw", choices=BINARY_MODES)
    c.add_argument("-o", "--output", help="a folder that tasks write to; no row goes through the driver")
    c = command("json", "rows as JSON lines", "table")
    c.add_argument("-D", "--date-format")
    c.add_argument("-T", "--datetime-format")
    c.add_argument("-U", "--no-unprintable", action="store_true")
    c.add_argument("-o", "--output", help="a folder that tasks write to; no row goes through the driver")
    c = command("schema", "a CREATE script")
    c.add_argument("dialect", nargs="?", default="access")
    c.add_argument("-T", "--table")
    c.add_argument("-N", "--namespace")
    for name, what, usual in (("drop-table", D.DROP, False), ("not-null", D.NOT_NULL, True), ("default-values", D.DEFAULTS, False), ("not-empty", D.NOT_EMPTY, False), ("comments", D.COMMENTS, True), ("indexes", D.INDEXES, True), ("relations", D.RELATIONS, True)):
        c.add_argument(f"--{name}", dest=what, action=argparse.BooleanOptionalAction, default=usual)
    command("count", "rows of a table", "table")
    command("ver", "the version")
    c = command("prop", "properties of a table", "table")
    c = command("queries", "stored queries, or the text of one")
    c.add_argument("name", nargs="?")
    c = command("import", "append CSV files to a table", "table", "file")
    c.add_argument("-H", "--header", type=int, default=0, metavar="LINES")
    c.add_argument("-M", "--multi-line", action="store_true", help="quoted fields may span lines; a file is read by one task")
    c.add_argument("-d", "--delimiter", default=",")
    return p


def style_of(a: argparse.Namespace) -> Style:
    usual = Style()
    return Style(a.datetime_format or usual.datetime, a.date_format or usual.date, getattr(a, "boolean_words", False), getattr(a, "bin", "raw"))


def output(spark: SparkSession, a: argparse.Namespace) -> Iterator[str]:
    """The pieces of a command's output."""
    if a.command == "ver":
        from deskdb.sources.pagefile import version

        yield (version(a.database) if a.database.lower().endswith((".mdb", ".accdb")) else metadata.version(Database(spark, a.database))) + "\n"
        return
    db = open_database(spark, a.database)
    if a.command == "sql":
        shell = Shell(Engine(spark, db), not a.plain, unescaped(a.delimiter), not a.no_header, not a.no_footer)
        if a.input:
            with open(a.input, encoding="utf-8") as f:
                script = f.read()
        else:
            script = sys.stdin.read()
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.writelines(line + "\n" for line in shell.run(script))
        else:
            yield from (line + "\n" for line in shell.run(script))
    elif a.command == "tables":
        rows = metadata.list_objects(db, a.type, a.system).collect()
        names = [f"{r['object_type']} {r['name']}" if a.show_type else r["name"] for r in rows]
        yield "".join(n + "\n" for n in names) if a.single else unescaped(a.delimiter).join(names) + "\n"
    elif a.command == "export":
        df, schema = db.table(a.table, storage_order=bool(a.insert)), db.schema(a.table)
        if a.insert and a.output:
            write_inserts(df, a.output, db.find(a.table), a.insert, a.batch_size, a.namespace, style_of(a), a.quote, schema)
            return
        if a.insert:
            lines = inserts(df, db.find(a.table), a.insert, a.batch_size, a.namespace, style_of(a), a.quote, schema).orderBy("statement_no")
            yield from (r["line"] + "\n" for r in lines.toLocalIterator())
            return
        o = Delimited(unescaped(a.delimiter), unescaped(a.row_delimiter), not a.no_header, a.quote if a.quote is not None else '"', not a.no_quote, a.escape, a.escape_invisible, unescaped(a.null), style_of(a))
        if a.output:
            write_delimited(df, a.output, o, schema)
            return
        if o.header:
            yield header_line(schema, o) + o.row_end
        yield from (r["line"] + o.row_end for r in delimited(df, o, schema).toLocalIterator())
    elif a.command == "json" and a.output:
        write_json(db.table(a.table), a.output, style_of(a), a.no_unprintable, db.schema(a.table))
    elif a.command == "json":
        yield from (r["line"] + "\n" for r in json_lines(db.table(a.table), style_of(a), a.no_unprintable, db.schema(a.table)).toLocalIterator())
    elif a.command == "schema":
        wanted = {x for x in (*USUAL, D.DROP, D.DEFAULTS, D.NOT_EMPTY) if getattr(a, x)}
        yield from (line + "\n" for line in schema_lines(db, a.dialect, a.table, a.namespace, wanted))
    elif a.command == "count":
        yield f"{metadata.count(db, a.table)}\n"
    elif a.command == "prop":
        for r in metadata.properties(db, a.table).orderBy("column", "name").collect():
            yield f"{r['column'] or '(table)'}\t{r['name']}: {r['value']}\n"
    elif a.command == "queries":
        yield metadata.stored_query(db, a.name) + "\n" if a.name else " ".join(r["name"] for r in metadata.stored_queries(db).collect()) + "\n"
    elif a.command == "import":
        yield f"{import_csv(spark, a.file, f'{a.database}/{db.find(a.table)}.parquet', delimiter=unescaped(a.delimiter), skip=a.header, multi_line=a.multi_line)} rows\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        for piece in output(spark, a):
            sys.stdout.write(piece)
    except (DeskError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
