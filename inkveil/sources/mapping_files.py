"""Mapping tables as JSON or text, for exchange. The Parquet table is the store of record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

JSON_SCHEMA = T.StructType(
    [
        T.StructField("mappings", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reverse_mappings", T.MapType(T.StringType(), T.StringType())),
        T.StructField("counters", T.MapType(T.StringType(), T.LongType())),
    ]
)

#: Entries of one scope and prefix in an object, where scopes may be of any size.
SHARD_ROWS = 10_000

TEXT_HEADER = ("# Mapping Table (Placeholder -> Original)", "=" * 60)


ENTRY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("scope", "value", "placeholder", "prefix")]
    + [T.StructField("n", T.LongType()), T.StructField("first_seq", T.LongType()), T.StructField("first_pos", T.IntegerType())]
)


def export_json(mapping: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """``scope, shard, json``: one ``{mappings, reverse_mappings, counters}`` object per scope.

    The form for exchange with single programs: an object has to fit into one task. ``shard_rows``
    asks for several objects, each with so many values of a prefix at most; importing all of them
    gives the scope back; with ``SHARD_ROWS`` scopes may be of any size. ``write_entries`` has no objects at all.
    """
    entry = F.struct("first_seq", (-F.col("first_pos")).alias("back"), "value", "placeholder")
    shard = F.floor((F.col("n") - 1) / shard_rows) if shard_rows else F.lit(0).cast("bigint")
    sharded = mapping.withColumn("shard", shard)
    per_prefix = sharded.groupBy("scope", "shard", "prefix").agg(
        F.max("n").alias("top"), F.collect_list(entry).alias("part")
    )
    merged = per_prefix.groupBy("scope", "shard").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "top")))).alias("counters"),
        F.array_sort(F.flatten(F.collect_list("part"))).alias("entries"),
    )

    def pairs(key: str, value: str) -> Column:
        return F.map_from_entries(F.transform("entries", lambda e: F.struct(e[key], e[value])))

    body = F.struct(
        pairs("value", "placeholder").alias("mappings"),
        pairs("placeholder", "value").alias("reverse_mappings"),
        "counters",
    )
    return merged.select("scope", "shard", F.to_json(body).alias("json"))


def export_text(mapping: DataFrame) -> DataFrame:
    """``scope, placeholder, line`` ordered by placeholder as text, as the export file lists it."""
    line = F.concat_ws(" -> ", "placeholder", "value").alias("line")
    return mapping.select("scope", "placeholder", line).orderBy("scope", "placeholder")


def write_text(mapping: DataFrame, path: str, scope: str = "") -> None:
    """The lines of one scope under the two header lines, as text files in order."""
    spark = mapping.sparkSession
    head = spark.createDataFrame([(0, f"{i}", text) for i, text in enumerate(TEXT_HEADER)], "k int, key string, line string")
    lines = export_text(mapping.where(F.col("scope") == scope)).select(
        F.lit(1).alias("k"), F.col("placeholder").alias("key"), "line"
    )
    head.unionByName(lines).orderBy("k", "key").select("line").write.text(path)


def write_entries(mapping: DataFrame, path: str) -> None:
    """One JSON line per entry: the default export, the same at any size."""
    mapping.select(ENTRY.names).write.json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The mapping table that ``write_entries`` wrote."""
    return spark.read.schema(ENTRY).json(path)


def write_json(mapping: DataFrame, path: str, shard_rows: int | None = None) -> None:
    """One JSON object per line, with its scope and shard as folders."""
    export_json(mapping, shard_rows).write.partitionBy("scope", "shard").text(path)


def import_json(spark: SparkSession, path: str, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A mapping table from JSON files, and the files that are not such objects.

    The scope is ``scope``, else the one whose folder holds the file, else the empty one. A missing
    key counts as empty. Numbers and prefixes come from the placeholders, so a
    file without counters cannot make numbering start over.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    corrupt = T.StructField("_bad", T.StringType())
    schema = T.StructType([*JSON_SCHEMA.fields, corrupt])
    parsed = files.withColumn(
        "j", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    )
    # Folder names and the file's address each escape special characters once.
    folder = F.regexp_extract("file", r"/scope=([^/]*)/", 1)
    for _ in range(2):
        folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    of = F.lit(scope) if scope is not None else F.when(folder == "__HIVE_DEFAULT_PARTITION__", "").otherwise(folder)
    rejected = parsed.where("j is null or j._bad is not null").select("file")
    entries = (
        parsed.where("j._bad is null")
        .select("file", F.posexplode("j.mappings").alias("pos", "value", "placeholder"))
        .select(
            of.alias("scope"),
            "value",
            "placeholder",
            F.regexp_extract("placeholder", r"^\[(.*)_[0-9]+\]$", 1).alias("prefix"),
            F.expr(r"try_cast(regexp_extract(placeholder, '_([0-9]+)\\]$', 1) as bigint)").alias("n"),
            F.col("pos").cast("bigint").alias("first_seq"),
            F.lit(0).alias("first_pos"),
        )
    )
    return entries, rejected
