"""Tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a table that one task searches, about.
TASK_ROWS = 100_000


def parts_needed(df: DataFrame) -> int | None:
    """How many partitions a table's rows should be dealt out to; None if they lie well as they are.

    Rows are counted by partition, which reads no columns of a Parquet table: a large row group is one task's, and
    leaves the other splits of its file empty, however many there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).count()
    rows, most = held.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    even = df.rdd.getNumPartitions() >= cores and most * cores <= 2 * rows
    return None if even and most <= 2 * TASK_ROWS else max(2 * cores, -(-rows // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when few tasks hold most of them, and into tasks of bounded size.

    Searching texts is bound by CPU, so a table in one file, or in few large row groups, would keep few cores busy. Inputs
    with enough even partitions are left as they are.
    """
    parts = parts_needed(df)
    return df if parts is None else df.repartition(parts, *keys)


def spread_stream(stream: DataFrame, at_rest: DataFrame, *keys: str) -> DataFrame:
    """``spread`` for a stream of files whose next micro-batch holds about the rows of ``at_rest``.

    A micro-batch packs many small files into a task by their sizes in bytes, however many rows those hold.
    """
    parts = parts_needed(at_rest)
    return stream if parts is None else stream.repartition(parts, *keys)


def read_table(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A Parquet table, spread by ``keys`` when few tasks hold its rows."""
    return spread(spark.read.parquet(path), *keys)
