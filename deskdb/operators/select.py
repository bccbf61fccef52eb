"""SELECT over one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskdb.catalog import STORAGE_ORDER, Database
from deskdb.sql import nodes as N
from deskdb.sql.compile import predicate, quote, resolve


#: Limits up to which each task keeps its own first rows and one task merges them.
FEW = 100_000
#: Rows of a file that are counted together, as a power of two.
BLOCK_BITS = 16


def first_rows(df: DataFrame, n: int, keep: list, stored: bool = True) -> DataFrame:
    """The first ``n`` rows in storage order. Nothing is sorted as a whole.

    Up to FEW rows every task keeps its own first n. Beyond that the place of the n-th row is found by counting: the rows of each file, then of each block
    of the file in which it falls, then within the block; the result is a filter on file and row, which also leaves later files unread. Rows that
    have no place in files (``stored`` false) are always taken the first way.
    """
    if n <= FEW or not stored:
        return df.orderBy(*STORAGE_ORDER).limit(n).select(*keep)
    file, row = map(F.col, STORAGE_ORDER)
    left, last, block = n, None, None
    for r in sorted(df.groupBy(file.alias("f")).count().collect()):  # a row for each file
        if left <= r["count"]:
            last = r["f"]
            break
        left -= r["count"]
    if last is None:
        return df.select(*keep)
    own = df.filter(file == last)
    for r in sorted(own.groupBy(F.shiftright(row, BLOCK_BITS).alias("b")).count().collect()):  # a row for each block of one file
        if left <= r["count"]:
            block = r["b"]
            break
        left -= r["count"]
    inside = own.filter(F.shiftright(row, BLOCK_BITS) == block).orderBy(row).limit(left).agg(F.max(row).alias("m")).head()["m"]
    return df.filter((file < last) | ((file == last) & (row <= inside))).select(*keep)


def percent_rows(rows: int, percent: int) -> int:
    """How many rows a hundredth share of a table's rows is."""
    return int(float(rows) / 100 * percent)


def count_rows(df: DataFrame) -> DataFrame:
    """One row, one column ``count``."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def select(db: Database, query: N.Select, collation: str | None = None) -> DataFrame:
    """The rows of a statement. Storage order is brought in only where a limit needs it; a negative limit is none.

    A percentage is of the whole table's rows, whatever the predicate; it doesn't apply to COUNT(*), which any limit of 1 or more leaves whole.
    """
    schema = db.schema(query.table)
    limited = query.limit is not None and (query.percent or query.limit >= 0) and query.columns is not None
    df = db.table(query.table, storage_order=limited)
    if query.where is not None:
        df = df.filter(predicate(query.where, schema, collation))
    if query.columns is None:
        counted = count_rows(df)
        return counted.limit(query.limit) if query.limit is not None and not query.percent and query.limit >= 0 else counted
    names = [f.name for f in schema] if query.columns == ("*",) else query.columns
    keep = [F.col(quote(resolve(schema, c).name)).alias(c) for c in names]
    if not limited:
        return df.select(*keep)
    n = percent_rows(db.table(query.table).count(), query.limit) if query.percent else query.limit
    return first_rows(df, n, keep, db.stored(query.table))
