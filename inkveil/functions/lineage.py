"""Intermediate tables in the shared checkpoint folder, which outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; local sessions without one get a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="inkveil-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_RUNS: list[str] = []


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all tables written within, removed at the end.

    Intermediate tables hold the sensitive values. A job that has written its results before the block
    ends leaves none of them behind; after a crash the folder ``inkveil-run-*`` is the cluster's to expire.
    """
    folder = f"{scratch_folder(spark).rstrip('/')}/inkveil-run-{uuid.uuid4().hex}"
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    What follows is planned on real sizes, reads only the columns it needs and is never
    recomputed from the text. It lies in the folder of the innermost ``scratch_run``, else in
    one that is the cluster's to expire.
    """
    spark = df.sparkSession
    folder = _RUNS[-1] if _RUNS else scratch_folder(spark).rstrip("/")
    path = f"{folder}/inkveil-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """Python workers get Arrow batches of about ``size`` at most in jobs that start within; each task holds several at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)
