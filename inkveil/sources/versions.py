"""Mapping entries in numbered versions, for several writers and for readers that go on.

A store is a folder: ``log/<version>.json`` says what a version added, replaced or forgot, ``entries/`` and
``counters/`` hold Parquet folders that versions name. A version is made by renaming its file to the next number,
which fails if another writer has taken it: the loser looks at what the others wrote, makes its entries again if they
met its scopes, and tries the next number. What no version names was never committed.

Entries lie in buckets by scope, and each version notes its buckets and the highest numbers of its prefixes. So a
micro-batch reads the counters, and entries of the buckets that its scopes fall in, not the whole mapping.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from inkveil.operators.mapping import mapping_schema

BUCKETS = 32
COMPACT_EVERY = 50


@dataclass(frozen=True)
class Version:
    """``kind``: add, replace (all earlier versions are over) or forget (hides scopes in earlier ones)."""

    number: int
    kind: str
    data: str
    buckets: tuple[int, ...] = ()
    writer: str = ""
    batch: int = -1

    @staticmethod
    def parsed(number: int, text: str) -> Version:
        v = json.loads(text)
        return Version(number, v["kind"], v["data"], tuple(v["buckets"]), v["writer"], v["batch"])

    @property
    def text(self) -> str:
        return json.dumps({"kind": self.kind, "data": self.data, "buckets": self.buckets, "writer": self.writer, "batch": self.batch})


class VersionedStore:
    """Mapping entries under ``path``. Entries of a scope never change; they are added to, or forgotten."""

    def __init__(self, spark: SparkSession, path: str, seq: T.DataType | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), buckets
        self.schema = mapping_schema(seq or T.LongType())
        self._known: dict[int, Version] = {}

    # --- versions

    def versions(self) -> list[Version]:
        """All versions from the last replacing one on, ascending. Each file is read once by a store object."""
        names = self._names()
        found = []
        for number in sorted(names, reverse=True):
            if number not in self._known:
                self._known[number] = Version.parsed(number, self._read_file(f"{self.path}/log/{number:020d}.json"))
            found.append(self._known[number])
            if found[-1].kind == "replace":
                break
        return found[::-1]

    def latest(self) -> int:
        """The highest version, 0 if there is none."""
        return max(self._names(), default=0)

    def committed(self, writer: str, batch: int) -> Version | None:
        """The version of a writer's batch, if it was committed and not replaced since."""
        return next((v for v in self.versions() if (v.writer, v.batch) == (writer, batch)), None)

    def add(self, make: Callable[[DataFrame, DataFrame], DataFrame], scopes: DataFrame, writer: str = "", batch: int = -1) -> tuple[DataFrame, DataFrame]:
        """Commit new entries of ``scopes`` (column ``scope``); returns the entries before and the new ones.

        ``make`` gets the entries and the counters (``scope, prefix, top``) that are stored, and is called again if another
        writer has been faster. A batch that its writer has committed is not made again: what it added then is returned.
        """
        wanted = tuple(r.b for r in scopes.select(self._bucket(F.col("scope")).alias("b")).distinct().collect())
        while True:
            seen = self.versions()
            done = next((v for v in seen if writer and (v.writer, v.batch) == (writer, batch)), None)
            if done:
                before = [v for v in seen if v.number < done.number]
                return self._entries(before, wanted), self._entries([done])
            number = self.latest() if not seen else seen[-1].number
            made = make(self._entries(seen, wanted), self._counters(seen))
            version = self._written(made, "add", number + 1, writer, batch)
            while not self._commit(version):
                others = [v for v in self.versions() if v.number >= version.number]
                if any(v.kind != "add" or set(v.buckets) & set(version.buckets) or (writer and (v.writer, v.batch) == (writer, batch)) for v in others):
                    break
                # Others wrote scopes of other buckets: the entries hold, under the next number.
                version = Version(others[-1].number + 1, version.kind, version.data, version.buckets, writer, batch)
            else:
                return self._entries(seen, wanted), self._entries([version])

    def replace(self, entries: DataFrame) -> None:
        """Make ``entries`` all that is stored, in one version; earlier ones stay readable by their number only."""
        version = self._written(entries, "replace", self.latest() + 1)
        while not self._commit(version):
            version = Version(self.latest() + 1, version.kind, version.data, version.buckets)

    def forget(self, scopes: list[str]) -> None:
        """Hide all entries that the scopes have so far; what comes later starts over."""
        data = uuid.uuid4().hex
        self.spark.createDataFrame([(s,) for s in scopes], "scope string").write.parquet(f"{self.path}/forgotten/{data}")
        buckets = tuple(range(self.n_buckets))
        while not self._commit(Version(self.latest() + 1, "forget", data, buckets)):
            pass

    def compact(self) -> None:
        """Write what is stored as one version, unless another writer is faster."""
        seen = self.versions()
        if seen:
            self._commit(self._written(self._entries(seen), "replace", seen[-1].number + 1))

    # --- reading

    def load(self, upto: int | None = None, scopes: DataFrame | None = None) -> DataFrame:
        """Entries of the latest version or of version ``upto``; with ``scopes``, those of the buckets they fall in."""
        wanted = None
        if scopes is not None:
            wanted = tuple(r.b for r in scopes.select(self._bucket(F.col("scope")).alias("b")).distinct().collect())
        seen = self.versions()
        if upto is not None and (not seen or seen[0].number > upto):
            raise ValueError(f"version {upto} was replaced or is not there")
        return self._entries([v for v in seen if upto is None or v.number <= upto], wanted)

    def counters(self) -> DataFrame:
        """``scope, prefix, top``: the highest number that each prefix has reached."""
        return self._counters(self.versions())

    def _bucket(self, scope: Column) -> Column:
        return F.pmod(F.xxhash64(scope), F.lit(self.n_buckets)).cast("int")

    def _entries(self, seen: list[Version], buckets: tuple[int, ...] | None = None) -> DataFrame:
        paths = []
        for v in seen:
            if v.kind != "forget":
                paths += [f"{self.path}/entries/{v.data}/bucket={b}" for b in v.buckets if buckets is None or b in buckets]
        return self._visible(self._parquet(self.schema, paths), seen).select(self.schema.names)

    def _counters(self, seen: list[Version]) -> DataFrame:
        schema = T.StructType([T.StructField("scope", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("top", T.LongType())])
        rows = self._parquet(schema, [f"{self.path}/counters/{v.data}" for v in seen if v.kind != "forget"])
        return self._visible(rows, seen).groupBy("scope", "prefix").agg(F.max("top").alias("top"))

    def _parquet(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("data", F.lit(""))
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
        return rows.withColumn("data", F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], "/(?:entries|counters)/([0-9a-f]{32})/", 1))

    def _visible(self, rows: DataFrame, seen: list[Version]) -> DataFrame:
        """Rows that no later version has forgotten."""
        forgets = [v for v in seen if v.kind == "forget"]
        if not forgets:
            return rows.drop("data")
        numbers = F.create_map(*(F.lit(x) for v in seen for x in (v.data, v.number)))
        hidden = self.spark.read.schema("scope string").option("recursiveFileLookup", True).parquet(*(f"{self.path}/forgotten/{v.data}" for v in forgets))
        data = F.regexp_extract(hidden.metadataColumn("_metadata")["file_path"], "/forgotten/([0-9a-f]{32})/", 1)
        last = hidden.select("scope", F.element_at(numbers, data).alias("upto")).groupBy("scope").agg(F.max("upto").alias("upto"))
        aged = rows.withColumn("number", F.element_at(numbers, F.col("data"))).join(last, "scope", "left")
        return aged.where("upto is null or number > upto").drop("data", "number", "upto")

    # --- writing

    def _written(self, entries: DataFrame, kind: str, number: int, writer: str = "", batch: int = -1) -> Version:
        data = uuid.uuid4().hex
        target = f"{self.path}/entries/{data}"
        dealt = entries.select(self.schema.names).withColumn("bucket", self._bucket(F.col("scope")))
        dealt.write.partitionBy("bucket").parquet(target)
        buckets = self._buckets_of(target)
        stored = self._parquet(self.schema, [f"{target}/bucket={b}" for b in buckets])
        stored.groupBy("scope", "prefix").agg(F.max("n").alias("top")).write.parquet(f"{self.path}/counters/{data}")
        return Version(number, kind, data, buckets, writer, batch)

    def _buckets_of(self, folder: str) -> tuple[int, ...]:
        return tuple(sorted(int(n.removeprefix("bucket=")) for n in self._listed(folder) if n.startswith("bucket=")))

    def _commit(self, version: Version) -> bool:
        """Whether the number was still free: the rename fails if it is taken, however close two writers are."""
        log = f"{self.path}/log"
        fs, folder = self._file_system(log)
        fs.mkdirs(folder)
        draft = self._path(f"{log}/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(version.text.encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._path(f"{log}/{version.number:020d}.json")), options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _file_system(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _listed(self, path: str) -> list[str]:
        fs, p = self._file_system(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _names(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._listed(f"{self.path}/log") if n.endswith(".json") and not n.startswith(("_", "."))]

    def _read_file(self, path: str) -> str:
        fs, p = self._file_system(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
