"""What several operators share: scratch tables in the cluster's shared folder, and gapless numbering."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskdb.scratch import clear_scratch, scratch_path, shared_dir  # noqa: F401

#: The six ASCII white-space characters ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark deletes the shuffle files of a statement when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Statements that run in here leave no shuffle files: for what is written by ``saved`` step by step, where nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: Bytes that a task takes of a shuffle whose number of partitions is given.
TASK_BYTES = 128 << 20


def table_bytes(df: DataFrame) -> int:
    """What Spark expects ``df`` to take (for a table that was just written, the bytes of its files); 0 where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def tasks_for(spark: SparkSession, size: int, each: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of ``size`` bytes: spark.sql.shuffle.partitions, or more where a task would take over ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


#: Bytes for each core below which an input is dealt over the cores before Python works on it.
SMALL_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may be a single file, over all cores; others as they are, as their files make tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < table_bytes(df) < SMALL_BYTES * cores else df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def numbered(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps within each value of ``group``, in the order of ``order``.

    Rows are range-partitioned by group, order and a spreading column, so that a hot group (or many equal rows) is
    cut over many tasks. The positions within the tasks are written to the shared folder; then the counts of each
    (task, group), of which there are at most tasks + groups, give the offsets. ``df`` should be cheap to read twice
    (range partitioning samples it), ideally a ``saved`` table. ``group`` may be null (a group of its own).
    """
    spark = df.sparkSession
    spread, at = "__dd_spread", "__dd_at"
    placed = (
        df.withColumn(spread, F.monotonically_increasing_id())
        .repartitionByRange(tasks_for(spark, table_bytes(df)), group, *order, spread)
        .sortWithinPartitions(group, *order, spread)
        .withColumn(at, F.monotonically_increasing_id())
        .drop(spread)
    )
    placed = saved(placed, "numbered").withColumn("__dd_task", F.shiftright(at, 33))
    counts = placed.groupBy(F.col(group).alias("__dd_group"), F.col("__dd_task").alias("__dd_t")).agg(F.min(at).alias("__dd_first"), F.count(F.lit(1)).alias("__dd_n"))
    rows = sorted(counts.collect(), key=lambda r: (r["__dd_group"] is not None, r["__dd_group"] if r["__dd_group"] is not None else 0, r["__dd_t"]))
    before, last, table = 0, object(), []
    for r in rows:
        before = before if r["__dd_group"] == last else 0
        table.append((r["__dd_group"], r["__dd_t"], before - r["__dd_first"]))
        before, last = before + r["__dd_n"], r["__dd_group"]
    shifts = spark.createDataFrame(table, counts.select("__dd_group", "__dd_t", F.col("__dd_first").alias("__dd_shift")).schema)
    # tasks + groups rows: a bound that doesn't follow the rows
    joined = placed.join(F.broadcast(shifts), F.col(group).eqNullSafe(F.col("__dd_group")) & (F.col("__dd_task") == F.col("__dd_t")))
    return joined.withColumn(out, F.col(at) + F.col("__dd_shift")).drop(at, "__dd_task", "__dd_group", "__dd_t", "__dd_shift")


def keep_rows(docs: DataFrame, kept: DataFrame, keys: dict[str, Column], repeated: bool, best: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (expressions over docs; null equals null) are a row of ``kept``, with docs' columns.

    ``repeated``: whether rows of docs may agree on the keys; of those the one with the greatest ``best`` stays. The keys' side is built into
    the hash tables, so texts are shuffled once and never sorted.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__dd_row"), *[c.alias(f"__dd_{k}") for k, c in keys.items()], best.alias("__dd_best"))
    kept = kept.select(*[F.col(k).alias(f"__dd_k_{k}") for k in keys]).hint("shuffle_hash")
    on = [F.col(f"__dd_{k}").eqNullSafe(F.col(f"__dd_k_{k}")) for k in keys]
    found = own.join(kept, on, "left_semi")
    if repeated:
        found = found.groupBy(*[f"__dd_{k}" for k in keys]).agg(F.max_by("__dd_row", "__dd_best").alias("__dd_row"))
    return found.select("__dd_row.*")
