"""Benchmark decontamination over a positional inverted index.

The index is partitioned by document: each row of the index table is a segment, the postings of a
few megabytes of neighbouring documents (its terms, and for each term its sorted positions). The
windows of all test items are made in tasks, sorted and stored as a table of blocks of bounded size,
cut between windows or owners of a window, never by items, so an item may be of any length. The driver takes as many blocks at a time
as stay within that size, however many parts they were made in, and has them looked up in every segment, so postings are never
shuffled and a segment and the windows of one block's size are all that a task holds. Within a segment a window (13 consecutive
words of a test item) starts from the postings of its rarest term, and the lists of the other terms,
rarest first, each less the term's offset, are intersected with it until nothing is left.

Defined results: null and empty texts have no words and are never contaminated. Rows are documents:
repeated or null ``doc_id``s give one result row each. Items of fewer than 13 words are one window,
items without words none; items that share an id are one item, and a null id counts as the item ''.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Row

from inkveil.functions.lineage import written
from inkveil.llm.workers import frugal

WINDOW = 13
SLOP = 3
GAP = WINDOW + SLOP
SEGMENT_BYTES = 2 << 20
#: Bytes of windows and owners in a block, some 400,000 windows; a single window beyond it is a block of its own.
BLOCK_BYTES = 32 << 20
#: Starts that a task follows at a time.
CANDIDATES = 1 << 20

#: Keeps 0-9, a-z and all bytes of characters beyond ASCII; lowers A-Z; all else separates words.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_INDEX = "segment bigint, docs array<bigint>, starts binary, terms binary, ends binary, positions binary"
_BLOCK = "block bigint, lengths binary, codes binary, terms binary, owners array<array<string>>, again boolean, size bigint"
_HITS = (
    "segment bigint, place int, doc_id bigint, n_words bigint, hits array<struct<s:bigint,e:bigint>>, "
    "items array<string>, n_near bigint"
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _segment(number: int, ids: list, texts: list[bytes]) -> dict:
    """Postings of some documents; between two documents ``GAP`` positions stay free."""
    folded = np.frombuffer((b" ".join(texts) + b" ").translate(_FOLD), dtype=np.uint8)
    inside = folded != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begins, ends = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    lengths = np.diff(np.searchsorted(begins, bounds))
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    terms = every.dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = GAP + np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]])
    places = np.arange(len(codes)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    return {
        "segment": number,
        "docs": ids,
        "starts": np.stack([starts, starts + lengths]).astype("<i8").tobytes(),
        "terms": b" ".join(terms.dictionary.to_pylist()),
        "ends": np.cumsum(np.bincount(codes, minlength=len(terms.dictionary))).astype("<i8").tobytes(),
        "positions": places[order].astype("<u4").tobytes(),
    }


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    schema = pa.schema(
        [("segment", pa.int64()), ("docs", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("starts", "terms", "ends", "positions"))]
    )
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
            if size >= SEGMENT_BYTES or len(ids) >= 20_000:
                yield pa.RecordBatch.from_pylist([_segment(number, ids, texts)], schema)
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield pa.RecordBatch.from_pylist([_segment(number, ids, texts)], schema)


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of whole texts, one row per segment."""
    wanted = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(wanted.mapInArrow(frugal(_segments), _INDEX))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of every item, each with the item."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words(text)
            n = max(1, len(w) - WINDOW + 1) if w else 0
            for at in range(0, n, 10_000):
                made = [b" ".join(w[i : i + WINDOW]).decode() for i in range(at, min(at + 10_000, n))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([item] * len(made), pa.string())], names=["window", "item"])


def _block(number: int, held: list[tuple[str, list[str]]], again: bool, size: int) -> pa.RecordBatch:
    cut = pc.split_pattern(pa.array([w for w, _ in held], pa.string()), " ")
    lengths, terms = cut.value_lengths().to_numpy(), cut.flatten().dictionary_encode()
    # Short windows are filled up with a code that every segment is taken to hold.
    codes = np.full((len(held), WINDOW), len(terms.dictionary), dtype="<i4")
    codes[np.arange(WINDOW) < lengths[:, None]] = terms.indices.to_numpy()
    row = {
        "block": number,
        "lengths": lengths.astype("<i8").tobytes(),
        "codes": codes.tobytes(),
        "terms": " ".join(terms.dictionary.to_pylist()).encode(),
        "owners": [owners for _, owners in held],
        "again": again,
        "size": size,
    }
    binary = [(n, pa.binary()) for n in ("lengths", "codes", "terms")]
    schema = pa.schema([("block", pa.int64()), *binary, ("owners", pa.list_(pa.list_(pa.string()))), ("again", pa.bool_()), ("size", pa.int64())])
    return pa.RecordBatch.from_pylist([row], schema)


def _packed(size: int):
    """Sorted windows and owners, packed into blocks of ``size`` bytes; ``again``: the first window also ends the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, weight, again = TaskContext.get().partitionId() << 32, [], 0, False
        for batch in batches:
            for window, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                same = bool(held) and held[-1][0] == window
                if held and weight + len(window) + len(item) > size:
                    yield _block(number, held, again, weight)
                    number, held, weight, again, same = number + 1, [], 0, same, False
                if same:
                    held[-1][1].append(item)
                else:
                    held.append((window, [item]))
                weight += len(window) + len(item)
        if held:
            yield _block(number, held, again, weight)

    return run


class Windows:
    """The windows of some blocks that follow each other."""

    def __init__(self, rows: list[Row]):
        """``rows``: of the table of blocks, in order."""
        self.owners = [owners for row in rows for owners in row.owners]
        self.lengths = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(bytes(row.lengths), dtype="<i8") for row in rows)])
        places: dict[bytes, int] = {}
        codes = [np.zeros((0, WINDOW), dtype="<i4")]
        for row in rows:
            # -1 stands for the code that fills short windows up.
            place = np.array([*(places.setdefault(term, len(places)) for term in bytes(row.terms).split()), -1], dtype="<i4")
            codes.append(place[np.frombuffer(bytes(row.codes), dtype="<i4")].reshape(-1, WINDOW))
        self.terms = list(places)
        self.codes = np.concatenate(codes)
        self.codes[self.codes < 0] = len(self.terms)
        #: Windows that end the block before as well.
        firsts = np.cumsum([0, *(len(row.owners) for row in rows)])[:-1].tolist()
        self.again = {first for first, row in zip(firsts, rows, strict=True) if row.again}

    def matches(self, terms: list[bytes], ends: np.ndarray, positions: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows found in a segment, their starts, and which of them are exact; the others are loose.

        A match is loose if each word stands within ``SLOP`` words of its place in the window. All
        windows move on together: step k keeps the starts that the list of each window's k-th
        rarest term confirms.
        """
        at = pc.index_in(pa.array(self.terms, pa.binary()), value_set=pa.array(terms, pa.binary()))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        # One sorted list of all postings, by term and position, serves every list at once.
        keys = (np.repeat(np.arange(len(terms)), ends - begins) << 32) + positions
        counts = np.append(np.where(at >= 0, (ends - begins)[at], 0), np.iinfo(np.int64).max)
        here = counts[self.codes]
        alive = np.flatnonzero((here > 0).all(axis=1))
        order = np.argsort(here[alive], axis=1, kind="stable")
        first = at[self.codes[alive, order[:, 0]]]
        sizes = (ends - begins)[first]
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(sizes) // CANDIDATES)) + 1):
            n = sizes[part]
            win = np.repeat(part, n)
            spot = np.arange(n.sum()) + np.repeat(begins[first[part]] - np.cumsum(n) + n, n)
            start = positions[spot] - order[win, 0]
            exact = np.ones(len(start), dtype=bool)
            for k in range(1, WINDOW):
                if not len(start):
                    break
                offset = order[win, k]
                code = self.codes[alive[win], offset]
                filler = code == len(self.terms)
                key = (at[np.where(filler, 0, code)] << 32) + start + offset
                low = np.minimum(np.searchsorted(keys, key - SLOP), len(keys) - 1)
                near = filler | ((keys[low] >= key - SLOP) & (keys[low] <= key + SLOP))
                win, start, key, filler = win[near], start[near], key[near], filler[near]
                spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                exact = exact[near] & (filler | (keys[spot] == key))
            yield alive[win], start, exact


def _look_up(block: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(_rows(block, row)), schema)

    schema = pa.schema(
        [("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64())]
        + [("hits", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string())), ("n_near", pa.int64())]
    )
    return run


def _rows(block: Windows, row: dict) -> Iterator[dict]:
    begins, ends = np.frombuffer(row["starts"], dtype="<i8").reshape(2, -1)
    positions = np.frombuffer(row["positions"], dtype="<u4").astype(np.int64)
    hits: dict[int, list] = {}
    items: dict[int, set] = {}
    near: dict[int, int] = {}
    found = block.matches(row["terms"].split(), np.frombuffer(row["ends"], dtype="<i8"), positions) if len(positions) else ()
    for windows, starts, exact in found:
        places = np.searchsorted(begins, starts, side="right") - 1
        for w, start, d, whole in zip(windows.tolist(), starts.tolist(), places.clip(0).tolist(), exact.tolist(), strict=True):
            if whole:
                hits.setdefault(d, []).append((start, start + int(block.lengths[w])))
                items.setdefault(d, set()).update(block.owners[w])
            elif w not in block.again:
                near[d] = near.get(d, 0) + 1
    for d, doc in enumerate(row["docs"]):
        merged: list[dict] = []
        for s, e in sorted(hits.get(d, ())):
            if merged and s <= merged[-1]["e"]:
                merged[-1]["e"] = max(e, merged[-1]["e"])
            else:
                merged.append({"s": s, "e": e})
        yield {
            "segment": row["segment"], "place": d, "doc_id": doc, "n_words": int(ends[d] - begins[d]),
            "hits": merged, "items": sorted(items.get(d, ())), "n_near": near.get(d, 0),
        }


def blocks(tests: DataFrame, item: str, text: str) -> DataFrame:
    """The stored table of blocks: the distinct windows of all items, with the items."""
    named = tests.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    windows = written(named.mapInArrow(frugal(_windows), "window string, item string").distinct())
    size = windows.agg(F.sum(F.length("window") + F.length("item"))).first()[0] or 0
    # Equal windows meet in one part, so that one with very many owners is cut knowingly.
    ordered = windows.repartitionByRange(-(-size // BLOCK_BYTES) or 1, "window").sortWithinPartitions("window", "item")
    return written(ordered.mapInArrow(frugal(_packed(BLOCK_BYTES)), _BLOCK))


def _together(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of blocks, in order, put together as long as their sizes stay within ``BLOCK_BYTES``."""
    groups: list[list[int]] = []
    room = 0
    for number, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = BLOCK_BYTES
        groups[-1].append(number)
        room -= size
    return groups


def look_up(index: DataFrame, tests: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: hit ranges, items with exact matches, number of loose matches."""
    stored = blocks(tests, item, text)
    together = _together(sorted(map(tuple, stored.select("block", "size").collect())))  # a number for each block

    def looked_up(numbers: list[int]) -> DataFrame:
        block = Windows(stored.where(F.col("block").isin(numbers)).orderBy("block").collect() if numbers else [])
        return index.mapInArrow(frugal(_look_up(block)), _HITS)

    if len(together) < 2:
        return looked_up(together[0] if together else [])
    # Every result is written before the next blocks are taken, then merged by document.
    whole = written(looked_up(together[0]))
    for numbers in together[1:]:
        whole = whole.unionByName(written(looked_up(numbers)))
    return whole.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.flatten(F.collect_list("items")).alias("items"),
        F.sum("n_near").alias("n_near"),
    )


def contamination(docs: DataFrame, tests: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per document: words, words within an occurrence of a window, items, and the verdict (5 % or more hit)."""
    covered = (
        "aggregate(array_sort(hits), struct(0L AS n, 0L AS e), "
        "(a, x) -> struct(a.n + greatest(0L, x.e - greatest(a.e, x.s)) AS n, greatest(a.e, x.e) AS e), a -> a.n)"
    )
    found = look_up(build_index(docs, doc, text), tests, item, "text")
    return found.select(
        F.col("doc_id").alias(doc), "n_words", F.expr(covered).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "n_near"
    ).select(
        doc,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_near",
    )


def clean(docs: DataFrame, tests: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """All columns of the documents that are not contaminated."""
    # Rows are told apart by id and text, as ids may repeat or be null; nulls are marked, since the hash passes over them.
    key = F.xxhash64(*(part for c in (doc, text) for part in (F.col(c).isNull(), F.col(c).cast("string"))))
    found = contamination(docs.select(key.alias("key"), F.col(text).alias("text")), tests, "key", "text", item)
    bad = written(found.where("contaminated").select("key").distinct())
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(bad, "key", "left_anti").select("row.*")
