"""The prefix trie of conversations, with Count-min screening.

A node is a distinct sequence of first turns; its key is a chained digest, of the parent's key and the turn's
own digest. Texts are digested where they are read, so only digests and lengths move.

First every task counts the keys of its nodes in a Count-min sketch (``HASHES`` rows of cells that stop at
two), and the sketches are merged. An estimate is never too small: an estimate of one proves that the node, and
with it all below, belongs to one conversation. So from the first such node on a conversation's nodes are emitted as
they stand. Only nodes above may be shared; they are grouped exactly, by key, with partial aggregation. What a
subtree adds up is grouped the same way: every node is charged to the path of its smallest member.
The sketch has at most ``CELLS`` cells a row. Where nodes are many more, fewer are proved single and more are grouped; the
results are the same.

Conversations are sorted by turn and read in order, in rows of at most ``PIECE`` nodes, so their length has no limit.
The members that end at a node are listed in ranges of ids, in parallel; one digest then runs over the lists.

Defined results: null roles and texts are empty. Turns with the same number (or none, which come first) go by the
SHA-256 of role and text, and repeated rows are turns of their own. Rows without an id belong to no conversation and are left
out. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkveil.functions.lineage import written
from inkveil.operators.rewrite import looked_up

FAMILY = 100
HEADS = 6
HASHES = 4
CELLS = 1 << 22
FEWEST_CELLS = 1 << 16
_BLOCK = 1 << 14
PIECE = 4096
KEY = 16
_LIST = 8192
ROOT = hashlib.sha256(b"").digest()[:KEY]
NOTHING = hashlib.sha256(b"").hexdigest()


def own_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, said`` (the digest of role and text) and the text's ``chars``."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    # The role's length keeps role and text apart.
    said = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)
    rows = conversations.where(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), said.alias("said"), F.length(t).alias("chars"))


def kept_turns(conv: Column) -> Column:
    """How many first turns a conversation has from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows of all rebuilt conversations, each with a row ``src`` -1, turns of its family (0), then its own (1), unsorted.

    The first turns of a family's head are few: the ranking stops at them before it shuffles. A conversation's own
    first turns are still there; ``_chained`` passes over them.
    """
    ids = turns.select("conv").distinct().withColumn("h", kept_turns(F.col("conv"))).withColumn("head", F.col("conv") - F.col("conv") % FAMILY)
    ids = written(ids)
    place = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "said")
    heads = turns.where(F.col("conv") % FAMILY == 0).withColumn("at", F.row_number().over(place)).where(F.col("at") < HEADS)
    heads = heads.select(F.col("conv").alias("head"), "at", "said", "chars")
    taken = ids.join(heads, "head").where("at <= h").select("conv", F.lit(0).alias("src"), F.col("at").cast("bigint").alias("turn"), "said", "chars")
    marks = ids.select("conv", F.lit(-1).alias("src"), F.lit(0).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("said"), F.lit(0).alias("chars"))
    own = turns.select("conv", F.lit(1).alias("src"), F.col("turn").cast("bigint").alias("turn"), "said", "chars")
    return own.unionByName(taken).unionByName(marks)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations: the depth before them, all keys and lengths of their turns, and whether they are the last."""
    names = ["conv", "above", "before", "keys", "chars", "last"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.bool_()]
    conv, depth, key, skip, above, before, keys, chars = None, 0, ROOT, 0, 0, ROOT, [], []
    for batch in batches:
        out = []
        for c, src, said, n in zip(*(batch.column(x).to_pylist() for x in ("conv", "src", "said", "chars")), strict=True):
            if src < 0:
                if conv is not None:
                    out.append((conv, above, before, b"".join(keys), chars, True))
                conv, depth, key, above, before, keys, chars = c, 0, ROOT, 0, ROOT, [], []
                skip = zlib.crc32(str(c).encode()) % HEADS
                continue
            if src == 1 and skip:
                skip -= 1
                continue
            if len(chars) == PIECE:
                out.append((conv, above, before, b"".join(keys), chars, False))
                above, before, keys, chars = depth, key, [], []
            key = hashlib.sha256(key + bytes.fromhex(said)).digest()[:KEY]
            depth += 1
            keys.append(key)
            chars.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)], names=names)
    if conv is not None:
        row = (conv, above, before, b"".join(keys), chars, True)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def chains(rows: DataFrame) -> DataFrame:
    """``conv, above, before, keys, chars, last``: the nodes of every conversation, from the top."""
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "src", F.asc_nulls_first("turn"), "said")
    schema = "conv bigint, above bigint, before binary, keys binary, chars array<int>, last boolean"
    return dealt.select("conv", "src", "said", "chars").mapInArrow(_chained, schema)


# --- the sketch


def _cells(keys: bytes, cells: int) -> np.ndarray:
    """One cell a hash for every key; keys are digests, so their bytes are hashes already."""
    return np.frombuffer(keys, dtype="<u4").reshape(-1, KEY // 4)[:, :HASHES].astype(np.int64) % cells


def _counted(cells: int):
    """The blocks of one task's sketch that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((HASHES, cells), dtype=np.uint8)
        for batch in batches:
            for keys in batch.column("keys").to_pylist():
                found = _cells(keys, cells)
                for h in range(HASHES):
                    at, n = np.unique(found[:, h], return_counts=True)
                    sketch[h, at] = np.minimum(2, sketch[h, at] + np.minimum(2, n)).astype(np.uint8)
        blocks = sketch.reshape(-1, _BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        packed = [zlib.compress(blocks[b].tobytes(), 1) for b in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], names=["block", "cells"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks added up; equal blocks follow one another."""
    block, total, out = None, None, []
    for batch in batches:
        for b, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            one = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            if b == block:
                total = np.minimum(2, total + one)
            else:
                if block is not None:
                    out.append((block, zlib.compress(total.tobytes(), 1)))
                block, total = b, one
    if block is not None:
        out.append((block, zlib.compress(total.tobytes(), 1)))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], names=["block", "cells"])


def sketch(pieces: DataFrame, n_nodes: int, cells: int | None = None) -> np.ndarray:
    """Cells of all nodes, 0, 1 or 2 (for more). At most ``HASHES * CELLS`` bytes come to the driver."""
    cells = cells or min(CELLS, max(FEWEST_CELLS, 1 << (4 * n_nodes).bit_length()))
    blocks = pieces.select("keys").mapInArrow(_counted(cells), "block bigint, cells binary")
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block bigint, cells binary")
    whole = np.zeros((HASHES * cells // _BLOCK, _BLOCK), dtype=np.uint8)
    for r in merged.collect():
        whole[r.block] = np.frombuffer(zlib.decompress(bytes(r.cells)), dtype=np.uint8)
    return whole.reshape(HASHES, cells)


def _screened(shared_sketch):
    """Adds ``single``: the depth of the piece's first node with an estimate of one, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_sketch.value
        for batch in batches:
            single = []
            for keys, above in zip(batch.column("keys").to_pylist(), batch.column("above").to_pylist(), strict=True):
                found = _cells(keys, counts.shape[1])
                alone = np.flatnonzero((counts[np.arange(HASHES), found] == 1).any(axis=1)) if len(found) else found
                single.append(above + 1 + int(alone[0]) if len(alone) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single, pa.int64())], names=[*batch.schema.names, "single"])

    return run


_NODES = "conv bigint, depth bigint, shared boolean, key binary, parent binary, chars int, last boolean, top boolean"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every node of every conversation; keys only where nodes may be shared, or hang below one."""
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_()]
    names = [f.split(" ")[0] for f in _NODES.split(", ")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        out = []
        for p in batch.to_pylist():
            single = p["single"] if p["single"] is not None else 1 << 62
            ends = p["above"] + len(p["chars"]) if p["last"] else -1
            if not p["above"]:
                out.append((p["conv"], 0, True, ROOT, None, 0, ends == 0, False))
            key = p["before"]
            for i, n in enumerate(p["chars"]):
                parent, key, depth = key, p["keys"][KEY * i : KEY * (i + 1)], p["above"] + i + 1
                shared, top = depth < single, depth == single
                out.append((p["conv"], depth, shared, key if shared else None, parent if shared or top else None, n, depth == ends, top))
            if len(out) > 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)


def screened(pieces: DataFrame) -> DataFrame:
    """``_NODES`` of all conversations: single nodes, and those that may be shared."""
    spark = pieces.sparkSession
    n_nodes = pieces.agg(F.sum(F.size("chars"))).first()[0] or 0
    counts = spark.sparkContext.broadcast(sketch(pieces, n_nodes))
    schema = "conv bigint, above bigint, before binary, keys binary, chars array<int>, last boolean"
    found = pieces.mapInArrow(_screened(counts), f"{schema}, single bigint")
    # Pieces of conversations that have several also learn of single nodes in the pieces above.
    whole = found.where("above = 0 and last")
    some = found.where("not (above = 0 and last)").withColumn("single", F.min("single").over(Window.partitionBy("conv")))
    return written(whole.unionByName(some).mapInArrow(_nodes, _NODES))


# --- exact groups


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node after the other, ascending, as lists of ``_LIST`` ids in decimal."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["key", "low", "ids"])

    key, ids, out = None, [], []
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == _LIST):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        if len(out) > 256:
            yield rows(out)
            out = []
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
    yield rows(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest is not None:
        out.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "ends"])


def ends_of(shared: DataFrame) -> DataFrame:
    """``key, ends``: the digest of the ids that end at each node which may be shared."""
    ending = shared.where("last").select("key", "conv")
    lists = ending.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_lists, "key binary, low bigint, ids string")
    return lists.repartition("key").sortWithinPartitions("key", "low").select("key", "ids").mapInArrow(_hashed, "key binary, ends string")


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every node of the rebuilt conversations."""
    nodes = screened(written(chains(rebuilt(own_turns(conversations, conv, turn, role, text)))))
    shared, single = nodes.where("shared"), nodes.where("not shared")

    tops = single.where("top").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("tops"))
    grouped = written(
        shared.groupBy("key").agg(F.count("*").alias("n"), F.min("conv").alias("m"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("parent").alias("parent"))
    )
    kids = grouped.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    counted = grouped.join(kids, "key", "left").join(tops, "key", "left")
    known = written(counted.withColumn("children", F.coalesce("kids", F.lit(0)) + F.coalesce("tops", F.lit(0))).drop("kids", "tops"))

    # What each node adds to itself and all above, charged to the path of its smallest member: copies saved, and a leaf.
    own = known.select(
        F.col("m").alias("conv"), "depth", ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.when(F.col("children") == 0, 1).otherwise(0).alias("leaf")
    ).where("saved > 0 or leaf > 0")
    paths = shared.select("conv", "depth", "key").join(own.select("conv").distinct(), "conv", "left_semi").join(own, ["conv", "depth"], "left")
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    charged = paths.select("key", F.sum(F.coalesce("saved", F.lit(0))).over(below).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0))).over(below).alias("leaves"))
    # A conversation with a single node is a leaf of all nodes above that.
    tails = single.where("top").select("conv").withColumn("leaves", F.lit(1).cast("bigint"))
    under = shared.select("conv", "key").join(tails, "conv").select("key", F.lit(0).cast("bigint").alias("saved"), "leaves")
    sums = charged.unionByName(under).groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    # Children meet their parents by key; hot parents are taken apart there.
    named = known.select(F.col("key").alias("parent"), F.col("m").alias("above"))
    asked = known.where("parent is not null").select("parent", "key").unionByName(single.where("top").select("parent", F.lit(None).cast("binary").alias("key"), "conv"), allowMissingColumns=True)
    above = written(looked_up(written(asked), named, ["parent"], "above"))
    above_shared = above.where("key is not null").select("key", "above")
    exact = known.join(above_shared, "key", "left").join(sums, "key", "left").join(ends_of(shared), "key", "left")
    columns = [F.col("m").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children")]
    exact = exact.select(*columns, F.coalesce("leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))

    above_single = above.where("key is null").select("conv", "above", F.lit(True).alias("top"))
    alone = single.select("conv", "depth", "last", "top").join(above_single, ["conv", "top"], "left")
    one = F.lit(1).cast("bigint")
    alone = alone.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("top"), F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return exact.unionByName(alone)
