"""A SELECT that follows a table: rows that arrive later are tested and projected as those that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from deskdb.errors import AnalysisError
from deskdb.sql.compile import predicate, quote, resolve
from deskdb.sql.parser import parse


def follow(source: DataFrame, sql: str) -> DataFrame:
    """``source`` (a stream, whatever the statement calls it) through the statement's predicate and columns. No shuffle and no state:
    TOP and LIMIT are refused, as a stream has no first rows; COUNT(*) is a running count (write it in complete or update mode)."""
    query = parse(sql)
    if getattr(query, "limit", None) is not None or not hasattr(query, "columns"):
        raise AnalysisError("only SELECT without TOP and LIMIT can follow a stream")
    df = source if query.where is None else source.filter(predicate(query.where, source.schema))
    if query.columns is None:
        return df.agg(F.count(F.lit(1)).alias("count"))
    names = source.columns if query.columns == ("*",) else query.columns
    return df.select(*[F.col(quote(resolve(source.schema, c).name)).alias(c) for c in names])


def follow_folder(spark: SparkSession, path: str, schema: T.StructType, sql: str, files_at_once: int = 1000) -> DataFrame:
    """follow() over the Parquet files of a folder, also those still to come."""
    return follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path), sql)
