"""Vectors as short codes: product quantisation with Ball k-means.

A vector's components become integers, ``floor(256 * x)``, and it is cut into ``PARTS`` equal parts. Every
part position has a codebook of ``ENTRIES`` entries; a code names the nearest entry of every part (squared
Euclidean distance, ties to the lower index).

The parts of an entry form a ball around it. After a round its radius (the farthest part, as the entries
were, plus how far the entry then moved) says which entries are its neighbours: only those at most two
radii away can take a part over. Within a ball, a part nearer to its entry than half the way to the nearest
neighbour lies in the stable core and stays. The others lie in rings, by the neighbours that are at most
twice as far from the entry as the part is: only these are compared. Balls of which neither the entry nor a
neighbour moved keep all their parts. All comparisons are exact, in integers, so the codes are those of a
full search.

A round is one pass over the vectors, in any number of tasks, that writes each with its code, and one sum by
part and entry (added up inside the tasks first). Only the codebooks, of a size given by the parameters,
come to the driver.

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out. Rows are
vectors: repeated ids stay; a null id is larger than all others, equal ids start entries in the order of
their vectors. With fewer rows than entries there are as many entries as rows. Vectors that are empty, that
have another length than the first one or one that ``PARTS`` does not divide, or that have components too large for exact
64-bit distances (over 2**18 at 64 components) keep their row, without code and error, and count in no codebook. Null labels are
one label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from inkveil.functions.lineage import written
from inkveil.operators.rewrite import looked_up

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
_SLICE = 4096


def largest(dim: int) -> int:
    """The largest integer component for which sums of squared differences are exact."""
    return 1 << (58 - dim.bit_length()) // 2


@dataclass(frozen=True)
class Balls:
    """Entries (part, entry, component) and, once parts have been assigned, what is near each entry."""

    entries: np.ndarray
    #: Neighbours of each entry, nearest first, and their squared distances; both end in padding.
    near: np.ndarray | None = None
    gaps: np.ndarray | None = None
    #: Balls that keep all their parts.
    still: np.ndarray | None = None

    @staticmethod
    def moved(before: np.ndarray, after: np.ndarray, far: np.ndarray) -> Balls:
        """``far``: squared distance of each entry's farthest part, from where the entry was before."""
        parts, k, _ = after.shape
        near, gaps = np.zeros((parts, k, k), dtype=np.int64), np.full((parts, k, k), np.iinfo(np.int64).max)
        still = np.zeros((parts, k), dtype=bool)
        shifts = ((after - before) ** 2).sum(axis=2)
        for p in range(parts):
            apart = ((after[p][:, None] - after[p][None]) ** 2).sum(axis=2)
            for i in range(k):
                radius = _up(int(far[p, i])) + _up(int(shifts[p, i]))
                reach = np.flatnonzero(apart[i] <= 4 * radius * radius)
                reach = reach[reach != i]
                reach = reach[np.argsort(apart[i, reach], kind="stable")]
                near[p, i, : len(reach)], gaps[p, i, : len(reach)] = reach, apart[i, reach]
                still[p, i] = not shifts[p, i] and not shifts[p, reach].any()
        return Balls(after, near, gaps, still)

    def first(self, x: np.ndarray, p: int) -> np.ndarray:
        """Nearest entries of parts that belong to no ball yet."""
        return np.concatenate([_squares(x[at : at + 512, None], self.entries[p][None]).argmin(axis=1) for at in range(0, len(x), 512)] or [np.zeros(0, dtype=np.int64)])

    def again(self, x: np.ndarray, own: np.ndarray, p: int) -> np.ndarray:
        """Nearest entries of parts ``x`` that belonged to the entries ``own``."""
        best = own.copy()
        rows = np.flatnonzero(~self.still[p][own])
        far = _squares(x[rows], self.entries[p][own[rows]])
        outside = 4 * far >= self.gaps[p, own[rows], 0]
        rows, far = rows[outside], far[outside]
        # How many neighbours the ring of each part has, ball by ball.
        rings = np.zeros(len(rows), dtype=np.int64)
        order = np.argsort(own[rows], kind="stable")
        ends = np.cumsum(np.bincount(own[rows], minlength=len(self.gaps[p])))
        for i in np.flatnonzero(np.diff(ends, prepend=0)):
            ball = order[ends[i - 1] if i else 0 : ends[i]]
            rings[ball] = np.searchsorted(self.gaps[p, i], 4 * far[ball], side="right")
        nth = 0
        while len(rows):
            at = self.near[p, own[rows], nth]
            gap = _squares(x[rows], self.entries[p][at])
            nearer = (gap < far) | ((gap == far) & (at < best[rows]))
            best[rows[nearer]], far[nearer] = at[nearer], gap[nearer]
            nth += 1
            left = rings > nth
            rows, far, rings = rows[left], far[left], rings[left]
        return best


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _up(square: int) -> int:
    """The root, rounded up."""
    return math.isqrt(square - 1) + 1 if square else 0


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Row, part, component."""
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, parts, -1)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.array([np.frombuffer(c, dtype="<u2") for c in batch.column("code").to_pylist()]).reshape(batch.num_rows, parts).astype(np.int64)


def _assign(balls: Balls, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(balls.entries)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                x = _matrix(batch, parts)
                if balls.near is None:
                    codes = np.stack([balls.first(x[:, p], p) for p in range(parts)], axis=1)
                else:
                    old = _codes(batch, parts)
                    codes = np.stack([balls.again(x[:, p], old[:, p], p) for p in range(parts)], axis=1)
                packed = pa.array([row.tobytes() for row in codes.astype("<u2")], pa.binary())
                if final:
                    errors = sum(_squares(x[:, p], balls.entries[p][codes[:, p]]) for p in range(parts))
                    columns = [batch.column("id"), batch.column("label"), packed, pa.array(errors, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])
                else:
                    columns = [batch.column("id"), batch.column("label"), batch.column("x"), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "code"])

    return run


def _sums(entries: np.ndarray):
    """One row of a task for every part, entry in use, and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = entries.shape
        counts, far = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        totals = np.zeros((parts, k, width), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                x, codes = _matrix(batch, parts), _codes(batch, parts)
                for p in range(parts):
                    own = codes[:, p]
                    counts[p] += np.bincount(own, minlength=k)
                    np.maximum.at(far[p], own, _squares(x[:, p], entries[p][own]))
                    np.add.at(totals[p], own, x[:, p])
        p, i, j = (a.ravel() for a in np.indices(totals.shape))
        used = counts[p, i] > 0
        p, i, j = p[used], i[used], j[used]
        columns = [p, i, j, totals[p, i, j], counts[p, i], far[p, i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "i", "j", "total", "n", "far"])

    return run


def _updated(assigned: DataFrame, entries: np.ndarray) -> Balls:
    """The entries moved to the floored means of their parts; at most one row an entry's component is collected."""
    sums = assigned.mapInArrow(_sums(entries), "p long, i long, j long, total long, n long, far long")
    grouped = sums.groupBy("p", "i", "j").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("far").alias("far")
    )
    after, far = entries.copy(), np.zeros(entries.shape[:2], dtype=np.int64)
    for r in grouped.collect():
        after[r.p, r.i, r.j] = int(r.total) // r.n
        far[r.p, r.i] = r.far
    return Balls.moved(entries, after, far)


def _first_entries(rows: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """The parts of the first rows, and the length of their vectors (0: no vector has a code)."""
    order = [F.asc_nulls_last("id"), "x"]
    got = rows.where("size(x) > 0").orderBy(*order).limit(entries).select("x").collect()
    dim = len(got[0].x) if got else 0
    if dim % parts:
        return np.zeros((parts, 0, 0), dtype=np.int64), 0
    if any(len(r.x) != dim or max(map(abs, r.x)) > largest(dim) for r in got):
        got = rows.where(_fit(dim)).orderBy(*order).limit(entries).select("x").collect()
    if not got:
        return np.zeros((parts, 0, 0), dtype=np.int64), 0
    return np.array([r.x for r in got], dtype=np.int64).reshape(len(got), parts, dim // parts).transpose(1, 0, 2).copy(), dim


def _fit(dim: int):
    top = largest(dim)
    return F.expr(f"size(x) = {dim} and forall(x, c -> c between -{top} and {top})")


def encoded(
    vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every kept row, and the codebooks (part, entry, component).

    ``code`` is one unsigned 16-bit little-endian index for every part.
    """
    whole = vectors.select(F.col(vec).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kept = whole.where("v is not null and forall(v, c -> coalesce(abs(c) < double('infinity'), false))")
    rows = kept.select("id", "label", F.expr(f"transform(v, c -> cast(floor(greatest(least(c, 1e15D), -1e15D) * {SCALE}) as bigint))").alias("x"))
    books, dim = _first_entries(rows, parts, entries)
    kept_types = [T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType)]
    code = T.StructField("code", T.BinaryType())
    state = T.StructType([*kept_types, T.StructField("x", T.ArrayType(T.IntegerType())), code])
    done = T.StructType([*kept_types, code, T.StructField("error", T.LongType())])
    if not dim:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error")), books
    fit = _fit(dim)
    at = rows.where(fit).withColumn("x", F.col("x").cast("array<int>"))
    balls = Balls(books)
    for _ in range(rounds):
        at = written(at.mapInArrow(_assign(balls, False), state))
        balls = _updated(at, balls.entries)
    coded = at.mapInArrow(_assign(balls, True), done)
    odd = rows.where(~fit).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return written(coded.unionByName(odd)), balls.entries


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row its code in hexadecimal digits, its error, its label's summed error, and the codebooks' digest.

    The sums by label are joined by broadcast if they are few; else hot labels are taken apart.
    """
    rows, books = encoded(vectors, vec, vector, label)
    # Two digits an index: the low byte of each pair, as codebooks have at most 256 entries here.
    whole = F.lower(F.hex("code"))
    code = F.regexp_replace(whole, "(..)..", "$1")
    none = F.col("label").isNull()
    keyed = rows.select("id", "error", code.alias("code"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l"), none.alias("none"))
    sums = written(keyed.groupBy("l", "none").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")))
    sums = sums.select("l", "none", F.expr("try_cast(s as bigint)").alias("label_error"))
    found = looked_up(keyed, sums, ["l", "none"], "label_error")
    return found.select(F.col("id").alias(vec), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
