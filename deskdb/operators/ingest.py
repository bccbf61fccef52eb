"""CSV files into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from deskdb import types as K
from deskdb.errors import AnalysisError
from deskdb.operators.change import append_to


def _read(field: T.StructField, col: Column) -> Column:
    t = field.dataType
    if isinstance(t, T.StringType):
        return col
    if isinstance(t, T.BooleanType):
        text = F.lower(F.trim(col))
        known = F.when(text.isin("1", "true", "yes", "-1"), True).when(text.isin("0", "false", "no"), False)
        return F.when(col.isNull() | (text == ""), False).otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit(f"{field.name}: not a boolean: "), col)).cast("boolean")))
    return F.trim(col).cast(t)  # ANSI: what can't be read is an error


def read_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", skip: int = 1, quote: str = '"', multi_line: bool = False) -> DataFrame:
    """The rows of CSV files, by position, after ``skip`` header lines of each file.

    Takes text, whole-number and boolean columns (1 is true). Whole numbers are decimal. An empty field is null, for a boolean false.
    A field that can't be read as its type is an error, and so is a line with another number of fields. Files are split over tasks at line ends;
    with ``multi_line`` a quoted field may span lines, and a file is read by one task (then at most one header line is skipped).
    """
    for f in schema:
        if not isinstance(f.dataType, (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            raise AnalysisError(f"{f.name}: {K.kind_of(f).name} can't be imported")
    if multi_line and skip > 1:
        raise AnalysisError("records that span lines go with one header line at most")
    raw = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(schema))])
    options = {"sep": delimiter, "quote": quote, "escape": quote, "mode": "FAILFAST"}
    if skip <= 1:
        rows = spark.read.schema(raw).options(header=skip == 1, enforceSchema=True, multiLine=multi_line, **options).csv(path)
    else:  # what is broadcast is a row for each file, as many as the listing that the driver holds anyway
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        first = lines.filter("block = 0").groupBy("file").agg(F.min("line").alias("first"))
        lines = lines.join(F.broadcast(first), "file").filter(f"(block > 0 or line >= first + {skip}) and value <> ''")
        rows = lines.select(F.from_csv("value", raw.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    return rows.select(*[_read(f, F.col(f"_c{k}")).alias(f.name) for k, f in enumerate(schema)])


def import_csv(spark: SparkSession, path: str, table: str, **how) -> int:
    """Appends CSV files to the Parquet table at ``table``; how many rows there were, counted as they are written."""
    seen = Observation()
    append_to(table, read_csv(spark, path, spark.read.parquet(table).schema, **how).observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])
