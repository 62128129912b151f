"""A session on disk: settings, and mapping entries that only ever grow by whole batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from inkveil import catalog
from inkveil.config import Config, CustomPattern
from inkveil.operators.mapping import mapping_schema
from inkveil.sources.versions import VersionedStore


class MappingStore:
    """Mapping entries under ``path``, one folder per batch.

    Writing a batch again replaces it, so a replayed batch leaves the same entries.
    Forgetting a scope hides its entries of that and earlier batches. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, seq: T.DataType | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = mapping_schema(seq or T.LongType())

    def append(self, entries: DataFrame, batch: int) -> None:
        entries.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/entries/batch={batch}")

    def forget(self, scopes: list[str], batch: int) -> None:
        """Hide the scopes' entries up to ``batch``; what was forgotten before stays forgotten."""
        rows = self.spark.createDataFrame([(s,) for s in scopes], "scope string")
        rows.write.mode("append").parquet(f"{self.path}/forgotten/batch={batch}")

    def compact(self, batch: int) -> None:
        """Write all entries up to ``batch`` as one snapshot; later loads start from it."""
        self.load(before=batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={batch}")

    def load(self, before: int | None = None) -> DataFrame:
        """Entries of all batches, or of those before ``before``."""
        limit = before if before is not None else (1 << 62)
        batched = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        base = -1
        snapshots = self._read("snapshots", batched)
        if snapshots is not None:
            base = snapshots.where(F.col("batch") < limit).agg(F.max("batch")).first()[0]
            base = -1 if base is None else base
        entries = self._read("entries", batched)
        rows = self.spark.createDataFrame([], batched)
        if entries is not None:
            rows = entries.where((F.col("batch") > base) & (F.col("batch") < limit))
        if base >= 0:
            rows = rows.unionByName(snapshots.where(F.col("batch") == base))
        forgotten = self._read("forgotten", T.StructType([batched["scope"], batched["batch"]]))
        if forgotten is not None:
            last = forgotten.where(F.col("batch") < limit).groupBy("scope").agg(F.max("batch").alias("upto"))
            rows = rows.join(last, "scope", "left").where("upto is null or batch > upto")
        return rows.select(self.schema.names)

    def _read(self, kind: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return None


def save_settings(spark: SparkSession, config: Config, path: str) -> None:
    state = {
        "enabled_patterns": {name: name in config.types for name in catalog.TYPE_NAMES},
        "custom_patterns": [[p.regex, p.prefix] for p in config.custom],
        "preserve_list": list(config.preserve),
        "custom_prefix": config.custom_prefix,
    }
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_settings(spark: SparkSession, path: str) -> Config:
    """The saved configuration; types it does not mention are enabled."""
    state = json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()["value"])
    enabled = state.get("enabled_patterns", {})
    return Config(
        types=frozenset(name for name in catalog.TYPE_NAMES if enabled.get(name, True)),
        custom=tuple(CustomPattern(regex, prefix) for regex, prefix in state.get("custom_patterns", [])),
        preserve=tuple(state.get("preserve_list", [])),
        custom_prefix=state.get("custom_prefix", "fixed"),
    )


def save_session(spark: SparkSession, config: Config, mapping: DataFrame, path: str) -> None:
    """Settings and mapping under ``path``; the mapping replaces what an earlier session left there, in one version."""
    save_settings(spark, config, f"{path}/settings")
    VersionedStore(spark, f"{path}/mapping", mapping.schema["first_seq"].dataType).replace(mapping)


def load_session(spark: SparkSession, path: str, seq: T.DataType | None = None) -> tuple[Config, DataFrame]:
    return load_settings(spark, f"{path}/settings"), VersionedStore(spark, f"{path}/mapping", seq).load()
