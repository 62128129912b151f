"""Documents from files, and redacted texts back to files."""

from __future__ import annotations

import itertools
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from inkveil.functions.lineage import small_batches
from inkveil.sources.tables import TASK_ROWS

# Ship this module's functions inside the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def listed_together(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks per core within, where Spark starts one for each of up to 10,000 folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_value_folders(spark: SparkSession, path: str) -> bool:
    """Whether what the folder holds lies in folders ``column=value``; its first child tells, as Spark refuses a mixture."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return False

    def first(folder):
        children = store.listStatusIterator(folder)
        while children.hasNext():
            child = children.next()
            if not child.getPath().getName().startswith(("_", ".")):
                return child
        return None

    child = first(target)
    if child is None or not child.isDirectory() or not re.match("[^=]+=.", child.getPath().getName()):
        return False
    inner = first(child.getPath())
    return inner is not None and inner.isFile()


def read_listed(spark: SparkSession, path: str, read: Callable[[DataFrameReader], DataFrame]) -> DataFrame:
    """``read`` with the files below ``path`` listed together.

    Files in folders ``column=value`` are listed without making columns of the names, which Spark does in a time
    that grows with the square of the folders.
    """
    with listed_together(spark):
        return read(spark.read.option("recursiveFileLookup", str(in_value_folders(spark, path)).lower()))


#: Bytes of small files that one task searches, about: some 100,000 log lines.
TASK_BYTES = 16 << 20


def dealt_out(rows: DataFrame, files: DataFrame, *keys: Column) -> DataFrame:
    """Rows of very many small files in tasks of some size; others stay where they were read.

    Spark counts a file as 4 MB more than it is, so a task holds some thirty small ones, and to begin with a task costs more than
    searching those. Only the sizes are looked at that the listing of ``files`` brought.
    """
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return rows.repartition(parts, *keys) if rows.rdd.getNumPartitions() > 4 * parts else rows


def read_documents(spark: SparkSession, path: str, unit: str = "file", fold_newlines: bool = True) -> DataFrame:
    """``doc_id`` (the file, or file and line start), ``text``.

    ``unit='file'``: one row per file, so patterns see whole documents. ``unit='line'`` is a
    different mode: patterns that span lines or start a document change meaning. Its ids sort, as text,
    in the order of the lines of a file.
    """
    if unit not in ("file", "line"):
        raise ValueError("unit must be 'file' or 'line'")
    raw = read_listed(spark, path, lambda reader: reader.text(path, wholetext=unit == "file"))
    file = F.col("_metadata.file_path")
    text = F.regexp_replace("value", "\r\n?", "\n") if fold_newlines else F.col("value")
    if unit == "file":
        return dealt_out(raw.select(file.alias("doc_id"), text.alias("text")), raw, F.col("doc_id"))
    lines = raw.select(file.alias("file"), F.monotonically_increasing_id().alias("line"), text.alias("text"))
    # Some thousand lines of a file stay together, so what is counted by file is few rows.
    lines = dealt_out(lines, raw, F.col("file"), F.shiftright("line", 13))
    return lines.select(F.concat_ws("#", "file", F.lpad(F.col("line").cast("string"), 19, "0")).alias("doc_id"), "text")


def read_uploads(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files as UTF-8, else Latin-1; with a ``cap``, files over so many bytes are listed apart and not read."""
    files = read_listed(spark, path, lambda reader: reader.format("binaryFile").load(path))
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    within = F.lit(True) if cap is None else F.col("length") <= cap
    accepted = files.where(within).select(F.col("path").alias("doc_id"), text.alias("text"))
    rejected = files.where(~within).select(F.col("path").alias("doc_id"), "length")
    # Lengths alone are read of rejected files, so a task can take very many.
    few = rejected.coalesce(4 * spark.sparkContext.defaultParallelism)
    return dealt_out(accepted, files, F.col("doc_id")), few


#: The folder's value where ``by`` is null or empty, and what Spark escapes in the names of such folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]""")


def _escaped(name: str) -> str:
    return _ESCAPED.sub(lambda found: f"%{ord(found[0]):02X}", name)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Lines that follow one another in a folder, as a value of its name and what its file holds."""
    for batch in batches:
        values, lines = pc.run_end_encode(batch["folder"]), batch["line"]
        start = 0
        for value, end in zip(values.values.to_pylist(), values.run_ends.to_pylist(), strict=True):
            yield value, b"".join((line or b"") + b"\n" for line in lines.slice(start, end - start).to_pylist())
            start = end


def _filer(root: str, by: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``folder, line``, sorted by folder, become files; a file appears under its name when it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, made = f"part-{task.partitionId():05d}-{run}.txt", 0
        for value, chunks in itertools.groupby(_runs(batches), key=lambda chunk: chunk[0]):
            folder = f"{root}/{_escaped(by)}={_escaped(value)}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{name}.{task.taskAttemptId()}"
            try:
                with open(part, "wb") as file:
                    file.writelines(lines for _, lines in chunks)
                os.replace(part, f"{folder}/{name}")
            finally:
                with suppress(FileNotFoundError):
                    os.unlink(part)
            made += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([made], pa.int64())})

    return write


def write_files(df: DataFrame, path: str, by: str, text: str = "text") -> None:
    """One text file for every value of ``by``, under a folder of that name.

    Files are made by several tasks per core, of bounded rows, as a file costs more than its lines. In local and mounted
    folders tasks make them directly: Hadoop starts eight processes there to set the rights of a file, its checksums
    and its folder, unless its native library is loaded. Elsewhere Spark's writer makes them, and each task moves its own to ``path``.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        writer = df.select(by, text).repartition(parts, by).write.partitionBy(by)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    # Spark makes the empty folder, so it refuses what it would refuse: a folder that is there, a column that is no text.
    empty = df.select(by, text).limit(0).write.partitionBy(by)
    empty.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)
    folder = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NO_VALUE))
    rows = df.select(folder.alias("folder"), F.col(text).cast("binary").alias("line")).repartition(parts, "folder").sortWithinPartitions("folder")
    with small_batches(spark):
        made = rows.mapInArrow(_filer(store.makeQualified(target).toUri().getPath(), by, uuid.uuid4().hex), "files bigint")
        made.write.format("noop").mode("overwrite").save()
    store.create(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")).close()


def write_redacted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", text: str = "redacted") -> None:
    """Write redacted rows; ``fmt='text'`` keeps the text column only."""
    if fmt == "text":
        df.select(text).write.mode(mode).text(path)
    else:
        df.write.mode(mode).format(fmt).save(path)
