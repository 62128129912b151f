"""Presets from folders of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil import catalog

SCHEMA = (
    "id string, name string, description string, patterns array<string>, preserve array<string>, "
    "custom_patterns array<struct<regex: string, prefix: string>>"
)


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; ``id`` falls back to the file's name, broken files are left out."""
    raw = (
        spark.read.schema(f"{SCHEMA}, _bad string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("pathGlobFilter", "*.json")
        .json(path, multiLine=True)
    )
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    good = raw.withColumn("id", F.coalesce("id", stem)).where("_bad is null")
    return good.drop("_bad")


def load_presets(spark: SparkSession, path: str) -> dict[str, dict]:
    """The presets of a folder as dictionaries by id, for ``Config``."""
    return {row["id"]: row.asDict(recursive=True) for row in read_presets(spark, path).toLocalIterator()}


def preset_table(spark: SparkSession) -> DataFrame:
    """The built-in presets as a table."""
    return spark.createDataFrame(list(catalog.PRESETS), SCHEMA)
