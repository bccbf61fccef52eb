"""Rows as lines of text: delimited, JSON, and INSERT statements. Every row is rendered where it is; nothing goes to the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from deskdb import types as K
from deskdb.catalog import STORAGE_ORDER
from deskdb.functions.values import Style, rendered
from deskdb.render.dialects import BULK, dialect
from deskdb.sql.compile import quote

_UNESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
#: Rows of one INSERT statement in dialects that take several.
BATCH = 1000


def unescaped(text: str) -> str:
    r"""An option as it was typed, with \n, \t, \r and \\ read."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "\\" and text[at + 1 : at + 2] in _UNESCAPES:
            out.append(_UNESCAPES[text[at + 1]])
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


@dataclass(frozen=True)
class Delimited:
    """Options of delimited output. escape: put before quotes (None: quotes are doubled). escape_invisible: CR, LF, TAB and \\ as two characters."""

    delimiter: str = ","
    row_end: str = "\n"
    header: bool = True
    quote: str = '"'
    quoting: bool = True
    escape: str | None = None
    escape_invisible: bool = False
    null: str = ""
    style: Style = field(default_factory=Style)


def is_quoted(f: T.StructField) -> bool:
    return K.kind_of(f).quoted or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))


def cell(f: T.StructField, o: Delimited, wrap: tuple[str, str] | None = None) -> Column:
    """A value as it stands in a line; the empty text is as null. ``wrap`` goes around it in place of quotes."""
    text = rendered(f, o.style)
    out = text
    if is_quoted(f):
        binary = isinstance(f.dataType, T.BinaryType)
        encoded = binary and o.style.binary in ("octal", "hex")
        if not encoded and o.quoting and o.quote:
            if o.escape:
                out = F.replace(out, F.lit(o.escape), F.lit(o.escape * 2)) if o.escape != o.quote else out
            out = F.replace(out, F.lit(o.quote), F.lit((o.escape or o.quote) + o.quote))
        if not encoded and o.escape_invisible:
            out = out if o.escape == "\\" and o.quoting else F.replace(out, F.lit("\\"), F.lit("\\\\"))
            for raw, said in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
                out = F.replace(out, F.lit(raw), F.lit(said))
        before, after = wrap or ((o.quote, o.quote) if o.quoting else ("", ""))
        out = F.concat(F.lit(before), out, F.lit(after))
    empty = text.isNull() | (text == "") if not isinstance(f.dataType, T.BinaryType) else F.col(quote(f.name)).isNull() | (F.length(quote(f.name)) == 0)
    return F.when(empty, F.lit(o.null)).otherwise(out)


def header_line(schema: T.StructType, o: Delimited) -> str:
    return o.delimiter.join(f.name for f in schema)


def delimited(df: DataFrame, o: Delimited = Delimited(), schema: T.StructType | None = None) -> DataFrame:
    """One column, line, for each row of ``df``; neither header nor row ends."""
    fields = [f for f in (schema or df.schema) if f.name not in STORAGE_ORDER]
    return df.select(F.concat_ws(o.delimiter, *[cell(f, o) for f in fields]).alias("line"))


def write_delimited(df: DataFrame, path: str, o: Delimited = Delimited(), schema: T.StructType | None = None) -> None:
    """Text files with ``o.row_end`` after each row; the header is the first line of each file."""
    lines = delimited(df, o, schema)
    fields = T.StructType([f for f in (schema or df.schema) if f.name not in STORAGE_ORDER])
    if not o.header:
        lines.write.text(path, lineSep=o.row_end)
        return
    head = header_line(fields, o)

    def with_head(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head], b.schema.field(0).type)], schema=b.schema)
            yield b

    lines.mapInArrow(with_head, "line string").write.text(path, lineSep=o.row_end)


def delimited_text(df: DataFrame, o: Delimited = Delimited(), schema: T.StructType | None = None) -> str:
    """All of it as one text, for small tables; rows in the order of ``df``."""
    fields = T.StructType([f for f in (schema or df.schema) if f.name not in STORAGE_ORDER])
    lines = [header_line(fields, o)] * o.header + [r["line"] for r in delimited(df, o, schema).toLocalIterator()]
    return "".join(x + o.row_end for x in lines)


def json_text(text: Column, blank_controls: bool) -> Column:
    """A JSON string literal: quotes and backslashes escaped, control characters as \\u00xx, or as blanks."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    if blank_controls:
        out = F.regexp_replace(out, r"[\x00-\x1f]", " ")
    else:
        controls = F.regexp_instr(out, F.lit(r"[\x00-\x1f]")) > 0
        each = out
        for c in range(32):
            each = F.replace(each, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
        out = F.when(controls, each).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_lines(df: DataFrame, style: Style = Style(), blank_controls: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """One column, line: a JSON object for each row. Null and empty values are left out; numbers, and booleans as 0 and 1, stand bare; binaries are base64."""
    parts = []
    for f in schema or df.schema:
        if f.name in STORAGE_ORDER:
            continue
        col = F.col(quote(f.name))
        key = json_text(F.lit(f.name), blank_controls)
        if isinstance(f.dataType, T.BinaryType):
            value = F.when(F.length(col) > 0, F.concat(F.lit('{"$binary": "'), F.base64(col), F.lit('", "$type": "00"}')))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(col)
        else:
            text = rendered(f, style)
            value = F.when(text != "", json_text(text, blank_controls) if is_quoted(f) else text)
        parts.append(F.concat(key, F.lit(":"), value))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("line"))


def _options(name: str, style: Style | None, quote_char: str | None) -> tuple[Delimited, dict]:
    d = dialect(name)
    style = style or Style(*d.formats)
    o = Delimited(", ", quote=quote_char or ("'" if name == "postgres" else '"'), null="NULL", style=style)
    binary = {"sqlite": ("X'", "'"), "mysql": ("0x", ""), "postgres": ("decode('", "', 'hex')")}.get(name) if style.binary == "hex" else None
    return o, {"binary": binary}


def value_tuples(df: DataFrame, dialect_name: str, style: Style | None = None, quote_char: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``line``: each row as ``(value, value)``, besides the storage order where ``df`` has it."""
    o, more = _options(dialect_name, style, quote_char)
    fields = [f for f in (schema or df.schema) if f.name not in STORAGE_ORDER]
    values = [cell(f, o, more["binary"] if isinstance(f.dataType, T.BinaryType) else None) for f in fields]
    keep = [c for c in STORAGE_ORDER if c in df.columns]
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *values), F.lit(")")).alias("line"), *keep)


#: Rows of a file that are numbered together where some are missing, as a power of two.
BLOCK_BITS = 16


def numbered_rows(df: DataFrame) -> DataFrame:
    """Adds ``__desk_n``, 1, 2, ... in storage order.

    Files are counted first. Where every file has its rows 0, 1, 2, ..., a row's number is the rows of the files before it plus its place: no row moves. Where
    rows are missing (a filter, or a table without files), blocks of 65,536 places are counted, and only rows of one block are sorted together.
    """
    spark, (file, row) = df.sparkSession, STORAGE_ORDER
    files = sorted(df.groupBy(F.col(file).alias("f")).agg(F.count(F.lit(1)).alias("c"), F.max(row).alias("m")).collect())  # a row for each file
    starts, at = [], 0
    for r in files:
        starts.append((r["f"], at))
        at += r["c"]
    before = spark.createDataFrame(starts, f"{file} string, __desk_b long")
    if all(r["m"] == r["c"] - 1 for r in files):
        return df.join(before, file).withColumn("__desk_n", F.col("__desk_b") + F.col(row) + 1).drop("__desk_b")
    block = F.shiftright(row, BLOCK_BITS)
    counts = df.groupBy(file, block.alias("__desk_k")).agg(F.count(F.lit(1)).alias("__desk_c"))
    sums = F.coalesce(F.sum("__desk_c").over(W.partitionBy(file).orderBy("__desk_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__desk_c", sums).join(before, file).select(file, "__desk_k", (F.col("__desk_c") + F.col("__desk_b")).alias("__desk_b"))
    own = df.withColumn("__desk_k", block).withColumn("__desk_r", F.row_number().over(W.partitionBy(file, "__desk_k").orderBy(row)))
    return own.join(counts, [file, "__desk_k"]).withColumn("__desk_n", F.col("__desk_b") + F.col("__desk_r")).drop("__desk_b", "__desk_r", "__desk_k")


def inserts(df: DataFrame, table: str, dialect_name: str, batch: int = BATCH, namespace: str | None = None, style: Style | None = None, quote_char: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``statement_no``, ``line``: INSERT statements, of up to ``batch`` rows in dialects that take several, of one otherwise.

    ``df`` has the storage order (Database.table(..., storage_order=True)). A statement gathers ``batch`` rows at most.
    """
    d = dialect(dialect_name)
    fields = [f for f in (schema or df.schema) if f.name not in STORAGE_ORDER]
    head = f"INSERT INTO {d.identifier(table, namespace)} ({', '.join(d.identifier(f.name) for f in fields)}) VALUES "
    rows = numbered_rows(value_tuples(df, dialect_name, style, quote_char, schema))
    size = batch if BULK in d.can else 1
    n = F.floor((F.col("__desk_n") - 1) / size).alias("statement_no")
    if size == 1:
        return rows.select(n, F.concat(F.lit(head), F.col("line"), F.lit(";")).alias("line"))
    grouped = rows.groupBy(n).agg(F.array_sort(F.collect_list(F.struct("__desk_n", "line"))).alias("r"))
    return grouped.select("statement_no", F.concat(F.lit(head), F.array_join(F.col("r.line"), ", "), F.lit(";")).alias("line"))


def write_inserts(df: DataFrame, path: str, *args, **how) -> None:
    """Text files of the statements that ``inserts`` gives, a line each, in their order over the files' names."""
    inserts(df, *args, **how).orderBy("statement_no").select("line").write.text(path)


def write_json(df: DataFrame, path: str, *args, **how) -> None:
    """Text files of JSON lines, written by the tasks that read the rows."""
    json_lines(df, *args, **how).write.text(path)
