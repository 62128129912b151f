"""SimHash near-duplicates by multi-index hashing.

A fingerprint holds 64 bits; a bit is set if it is set in more than half of the XXH64 hashes of the
document's word shingles. Two documents are linked if their fingerprints differ in at most two bits,
and the components of these links are the groups of copies.

Fingerprints are cut into two segments of 32 bits, each with its own table. Two bits can fall on
the segments as (0, 2), (2, 0) or (1, 1), so looking up the ball of radius 1 around the first segment
in the first table and the second segment itself in the second table meets every link. Each
match is verified by the distance of the whole fingerprints.

Copies are no work: only distinct fingerprints are looked up. A segment value that more than
``BUCKET`` distinct fingerprints share (a large group of near copies) would yield all their pairs,
so its table is kept one level finer: its members enumerate the ball of radius 1 of the *other*
segment as well, and everything that meets under one such key (the fingerprints there are all within
two bits of each other) is linked to the smallest. That is exact, and linear in the members.

Components come from alternating rounds of linking neighbours to the smallest one, on edges only, as
written tables; nothing is collected on the driver but counts.

Defined results: null and empty texts have the fingerprint 0 and are linked like all others; rows
with repeated or null ``doc_id`` are documents of their own, and a null id is never the id of a
component unless all its ids are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.lineage import written
from inkveil.llm.workers import frugal

SHINGLE = 3
SEED = 42
DISTANCE = 2
BUCKET = 64
_BLOCK = 1 << 16
_MASKS = [0, *(1 << b for b in range(32))]


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    return int(_fingerprint((text or "").encode()))


def _fingerprint(raw: bytes) -> np.uint64:
    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    counts = np.zeros(64, dtype=np.int64)
    joined, digest = b" ".join, xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        block = [digest(joined(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + _BLOCK))]
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1))
        prints = np.fromiter((_fingerprint(t) for t in texts), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "content"])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the bits as a signed long) and ``content`` (a hash of the text), written."""
    whole = F.col(text).cast("string")
    wanted = docs.select(F.col(doc).cast("bigint").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("content"))
    return written(wanted.mapInArrow(frugal(_fingerprints), "doc_id bigint, fp bigint, content bigint"))


def _high(fp: str = "fp") -> Column:
    return F.shiftrightunsigned(F.col(fp), 32)


def _low(fp: str = "fp") -> Column:
    return F.col(fp).bitwiseAND(0xFFFFFFFF)


def _ball(value: Column) -> Column:
    """The 32-bit ``value``, then all values one bit away from it."""
    return F.transform(F.array(*(F.lit(m).cast("bigint") for m in _MASKS)), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)``, ``a < b`` as longs, between distinct fingerprints that connect all that are linked.

    ``prints`` has distinct ``fp``. Within crowded buckets the edges are a star per shared key
    instead of all links; the components are the same.
    """
    first = F.struct(F.lit(1).alias("seg"), _high().alias("key"), _low().alias("rest"))
    second = F.struct(F.lit(2).alias("seg"), _low().alias("key"), _high().alias("rest"))
    table = prints.select("fp", F.inline(F.array(first, second)))
    crowded = written(table.groupBy("seg", "key").count().where(F.col("count") > BUCKET).select("seg", "key"))
    # Queries: the ball around the first segment, upwards only (each pair differs in one direction),
    # the centres; and the second segment itself.
    up = F.filter(_ball(F.col("key")), lambda v: v >= F.col("key"))
    asked = table.withColumn("at", F.explode(F.when(F.col("seg") == 1, up).otherwise(F.array("key"))))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    if crowded.isEmpty():
        hosts, askers, stars = table, asked, None
    else:
        hosts = table.join(crowded, ["seg", "key"], "left_anti")
        mark = crowded.select("seg", F.col("key").alias("at"), F.lit(True).alias("hot"))
        whole_ball = table.withColumn("at", F.explode(F.when(F.col("seg") == 1, _ball(F.col("key"))).otherwise(F.array("key"))))
        askers = asked.join(mark, ["seg", "at"], "left_anti")
        # Members of a crowded bucket bring the ball of the rest, others (one bit away) the rest itself.
        met = whole_ball.join(mark, ["seg", "at"], "left_semi").withColumn(
            "fine", F.explode(F.when(F.col("at") == F.col("key"), _ball(F.col("rest"))).otherwise(F.array("rest")))
        )
        met = written(met.select("seg", "at", "fine", "fp"))
        centre = met.groupBy("seg", "at", "fine").agg(F.min("fp").alias("other"))
        stars = met.join(centre, ["seg", "at", "fine"]).where((F.col("fp") != F.col("other")) & (far <= DISTANCE)).select("fp", "other")
    pairs = (
        askers.select("seg", "at", "fp", "key")
        .join(hosts.select("seg", F.col("key").alias("at"), F.col("fp").alias("other")), ["seg", "at"])
        .where((F.col("fp") != F.col("other")) & ((F.col("key") != F.col("at")) | (F.col("fp") < F.col("other"))) & (far <= DISTANCE))
        .select("fp", "other")
    )
    every = pairs if stars is None else pairs.unionByName(stars)
    return every.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest node of its component.

    Rounds of large-star (each node links its larger neighbours to the smallest of all) and small-star
    (links itself and its smaller neighbours to the smallest). They end when the edges are a star forest:
    no root has a root, and every other node has exactly one.
    """
    edges = written(edges.select("a", "b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(larger)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        smaller = large.join(down, "b")
        after = written(
            smaller.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(smaller.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        )
        # A node met twice has two roots, or is a root and has one.
        ends = after.select("b").unionByName(after.select(F.col("a").alias("b")).distinct())
        if ends.groupBy("b").count().where("count > 1").isEmpty():
            break
        edges = after
    return after.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(after.select(F.col("a"), F.col("a").alias("root")).distinct().toDF("node", "root"))


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``content`` and ``component_id`` of every row, written."""
    prints = fingerprints(docs, doc, text)
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    named = least.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named.where("root <> fp").unionByName(named.where("root = fp")))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(prints.join(named.join(heads, "root").select("fp", "component_id"), "fp"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, the fingerprint in 16 hex digits, and the smallest id of its group."""
    return groups(docs, doc, text).select(F.col("doc_id").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one row per group: of its smallest id, and of several such rows of the smallest content hash."""
    member = groups(docs, doc, text)
    # Groups whose ids are all null are told apart by their fingerprint components only, so they keep
    # one row per content.
    named = member.withColumn("group", F.when(F.col("component_id").isNull(), F.col("content")))
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    kept = written(named.groupBy("component_id", "group").agg(head.alias("h")).select("h.doc_id", "h.content"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("content"))
    chosen = rows.join(kept.toDF("i", "c"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")), "left_semi")
    counted = member.groupBy(F.col("doc_id").alias("i"), F.col("content").alias("c")).count().where("count > 1")
    repeated = kept.join(counted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")), "left_semi")
    return (chosen if repeated.isEmpty() else chosen.dropDuplicates(["doc_id", "content"])).select("row.*")
