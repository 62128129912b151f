"""The corpus pipeline: documents in, token files out.

Each stage takes the documents that the one before has written and returns a DataFrame; all but the
last return the columns of ``documents``. Rows need no unique id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.functions.lineage import scratch_folder, written
from inkveil.llm import language, mixing, postings, simhash, token_files


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    return language.accepted(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words are benchmark passages."""
    return postings.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, in the order of the mix: by number of the written files, then by row."""
    return mixing.mixed(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents lie, and a row per document, read back from them."""
    at = docs.metadataColumn("_metadata")
    part = F.regexp_extract(at["file_path"], r"part-(\d+)", 1).cast("bigint")
    path = f"{scratch_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, path, order=[part, at["row_index"]])
    return token_files.read(spark, path)


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_files", tokenised),
]

#: Language models, fingerprints and token ids are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
