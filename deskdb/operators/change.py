"""Changing tables: rows are appended, or rewritten where a predicate holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from deskdb.errors import AnalysisError, DeskError
from deskdb.sql.compile import literal, predicate, quote, resolve
from deskdb.sql.parser import Parser


def _where(text: str, schema: T.StructType):
    parser = Parser(text)
    node = parser.either()
    if parser.token.kind != "end":
        parser.fail("the end")
    return predicate(node, schema)


def updated(df: DataFrame, changes: dict[str, object], where: str | None = None) -> DataFrame:
    """``df`` with columns set to literals (None: null) where the dialect's predicate is true."""
    schema = df.schema
    test = _where(where, schema) if where else F.lit(True)
    new = {}
    for name, value in changes.items():
        field = resolve(schema, name)
        to = F.lit(None) if value is None else literal(field, value, "=")
        new[field.name] = F.when(test, to.cast(field.dataType)).otherwise(F.col(quote(field.name)))
    return df.select(*[new.get(f.name, F.col(quote(f.name))).alias(f.name) for f in schema])


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` and ``rows``, whose columns are matched by name without regard to capitals; missing ones are null."""
    own = {f.name.lower(): f for f in df.schema}
    extra = [c for c in rows.columns if c.lower() not in own]
    if extra:
        raise AnalysisError(f"no such column: {', '.join(extra)}")
    given = {c.lower(): c for c in rows.columns}
    return df.unionByName(rows.select(*[(F.col(quote(given[k])) if k in given else F.lit(None)).cast(f.dataType).alias(f.name) for k, f in own.items()]))


def append_to(path: str, rows: DataFrame) -> None:
    """Adds ``rows`` to the Parquet table at ``path``, in its schema."""
    own = rows.sparkSession.read.parquet(path)
    appended(own.limit(0), rows).write.mode("append").parquet(path)


def rewrite(spark: SparkSession, path: str, changes: dict[str, object], where: str | None = None) -> None:
    """Updates the Parquet table at ``path``: written beside it, then put in its place by two renames, between which no table is at ``path``.

    If the second fails, the old table is put back.
    """
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    updated(spark.read.parquet(path), changes, where).write.parquet(beside)
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = jvm.org.apache.hadoop.fs.Path(beside + ".old")
    if not store.rename(old, gone):
        raise DeskError(f"can't move {path}")
    if not store.rename(new, old):
        store.rename(gone, old)
        raise DeskError(f"can't move {beside} to {path}")
    store.delete(gone, True)
