"""Findings in files that are too large for one task.

A file is read by lines, in as many tasks as it has blocks. Where each line begins in the whole file is a running sum
inside its block plus the sizes of the blocks before. Lines are then dealt out to pieces of ``PIECE`` characters, and those near
a cut go to both sides, so a piece sees ``MARGIN`` characters beyond its ends. Each piece is searched as a text of its own; a
finding belongs to the piece that it begins in, so none counts twice. What is found is what a search of the whole file finds, as
long as findings that overlap each other span less than ``MARGIN`` characters (only private keys are not bounded at all).

A line is never cut. No text is gathered beyond a piece and its margins, and all but one copy of a line moves only if it is near a cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkveil.config import Config
from inkveil.functions.lineage import written
from inkveil.plans.pipelines import find

PIECE = 1 << 20
MARGIN = 1 << 16


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, id, start, value``: lines without their line feed, and where they begin in the file; written.

    Carriage returns stay: offsets are those of the file as it is.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    of = raw.metadataColumn("_metadata")
    rows = raw.select(of["file_path"].alias("file"), of["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    rows = written(rows)
    size = F.length("value").cast("bigint") + 1
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block: a file of a terabyte has some ten thousand.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(size).alias("size"))
    bases = blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    # Sizes alone are sorted and summed; the text stays out of the window.
    starts = rows.select("file", "block", "id", F.coalesce(F.sum(size).over(inside), F.lit(0)).alias("within"))
    placed = starts.join(bases, ["file", "block"]).select("id", (F.col("base") + F.col("within")).alias("start"))
    return written(rows.join(placed, "id"))


def pieces_of(lines: DataFrame, piece: int = PIECE, margin: int = MARGIN) -> DataFrame:
    """``file, piece, base, text``: the piece with its margins, and where that text begins in the file."""
    numbers = F.expr(f"sequence(greatest(0L, start - {margin}) div {piece}, (start + length(value) + {margin}) div {piece})")
    near = lines.select("file", "start", "value", F.explode(numbers).alias("piece"))
    grouped = near.groupBy("file", "piece").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("ls"))
    return grouped.select("file", "piece", F.col("ls")[0]["start"].alias("base"), F.array_join(F.transform("ls", lambda x: x.value), "\n").alias("text"))


def find_in_files(spark: SparkSession, path: str, config: Config, piece: int = PIECE, margin: int = MARGIN) -> DataFrame:
    """``file, type, value, start, end`` of all findings, with offsets in the whole file."""
    texts = pieces_of(lines_of(spark, path), piece, margin)
    found = find(texts, config, ["file", "piece", "base"])
    at = F.col("base") + F.col("start")
    return found.where(at.between(F.col("piece") * piece, F.col("piece") * piece + (piece - 1))).select(
        "file", "type", "value", at.alias("start"), (F.col("base") + F.col("end")).alias("end")
    )
