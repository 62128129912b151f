"""Redaction and restoring of streams."""

from __future__ import annotations

import itertools
import json
import os
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from inkveil.config import Config
from inkveil.functions.lineage import scratch_run
from inkveil.operators import audit
from inkveil.operators.mapping import scope_column
from inkveil.operators.numbering import EDITS, values_of
from inkveil.operators.restore import restore
from inkveil.operators.rewrite import apply_edits
from inkveil.plans.pipelines import redact_documents, redact_into, spanned
from inkveil.sources.versions import COMPACT_EVERY, VersionedStore


def redact_stream(df: DataFrame, config: Config, text: str = "text", out: str = "redacted") -> DataFrame:
    """Document scope: stateless, the same expression as in batch."""
    return redact_documents(df, config, text, out)


def redact_stream_to(
    df: DataFrame,
    config: Config,
    *,
    path: str,
    store: VersionedStore,
    checkpoint: str,
    doc: str,
    scope: str = "global",
    seq: str | None = None,
    text: str = "text",
    compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """Global or column scope, batch by batch against a stored mapping that other writers may add to.

    Each micro-batch numbers its new values after all stored ones, commits them as a version and writes its folder
    anew; a batch replayed after a failure finds its values stored and gives the same files. It reads the counters and the
    entries of its own scopes' buckets. One hot scope is still spread over all tasks. ``checkpoint`` names the writer.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_run(batch.sparkSession):
            result = redact_into(batch, config, store, doc=doc, scope=scope, seq=seq, text=text, writer=checkpoint, batch=batch_id)
            result.redacted.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
            # A replay needs no version of its own: its values are known by then, with the same placeholders.
            if (batch_id + 1) % compact_every == 0:
                store.compact()

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def restore_stream_to(
    df: DataFrame,
    mapping: DataFrame | VersionedStore,
    *,
    path: str,
    checkpoint: str,
    doc: str,
    scope: str = "global",
    text: str = "text",
) -> DataStreamWriter:
    """Restore each micro-batch against a mapping table, or against a store as it is when the batch comes.

    From a store, entries that were committed since the stream began are restored as well; only buckets of the
    batch's scopes are read.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_run(batch.sparkSession):
            known = mapping
            if isinstance(mapping, VersionedStore):
                known = mapping.load(scopes=batch.select(scope_column(scope).alias("scope")))
            restored = restore(batch, known, doc, scope, text)
            restored.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def count_stream_to(
    df: DataFrame, config: Config, *, path: str, checkpoint: str, keys: tuple[str, ...] = (), text: str = "text"
) -> DataStreamWriter:
    """Running counts of findings by type and ``keys``; the counts after batch ``k`` are ``path/batch=k``.

    The counts are stream state, kept with the batches that went into it, so a batch replayed after a failure or a restart
    isn't counted twice. Findings are counted where they are found; only counts are shuffled, and state has a row for each
    type and combination of keys. ``counted`` reads the last ones.
    """
    counts = audit.stats(audit.findings(spanned(df.select(*keys, text), config, text), *keys), *keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint)


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The counts after the last batch of ``count_stream_to``."""
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


# Ship this module's functions inside the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


OUT_ROWS = 10_000


def _with_edits(batch: pd.DataFrame, edits: list[str]) -> Iterator[pd.DataFrame]:
    """The rows with their edits, as JSON, some at a time."""
    slim = batch.drop(columns=[c for c in ("values_", "seq_", "scope_", "slot_") if c in batch.columns])
    for at in range(0, len(slim), OUT_ROWS):
        yield slim.iloc[at : at + OUT_ROWS].assign(edits=edits[at : at + OUT_ROWS])


def _edits(values: list[dict], known: dict[str, str]) -> str:
    made = [{"start": s["start"], "end": s["end"], "replacement": known[v["value"]]} for v in values for s in v["at"]]
    return json.dumps(sorted(made, key=lambda e: e["start"]))


class _Numberer(StatefulProcessor):
    """Placeholders of one scope: values with placeholders, prefix to highest number.

    A call to the state store costs more than reading some ten entries, so those of a scope are read and added to
    in one call each and not value by value; only values that the batch holds are kept in memory. Values come and edits go as JSON, which is small in pandas.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "value string, placeholder string", self.ttl_ms)
        self.top = handle.getMapState("top", "prefix string", "n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq_", kind="stable")
        known: dict[str, str] = {}
        if self.entries.exists():
            wanted = {v["value"] for values in batch["values_"] for v in json.loads(values)}
            known = {value: placeholder for value, placeholder in self.entries.get() if value in wanted}
        top: dict[str, int] = {}
        added, edits = [], []
        for text in batch["values_"]:
            values = json.loads(text)
            for v in sorted(values, key=lambda v: -v["last"]):
                if v["value"] not in known:
                    known[v["value"]] = self._placeholder(v["prefix"], top)
                    added.append((v["value"], known[v["value"]]))
            edits.append(_edits(values, known))
        if added:
            self.entries.appendList(added)
        for prefix, n in top.items():
            self.top.updateValue((prefix,), (n,))
        yield from _with_edits(batch, edits)

    def _placeholder(self, prefix: str, top: dict[str, int]) -> str:
        """The next placeholder; state is asked once per prefix and batch."""
        if prefix not in top:
            last = self.top.getValue((prefix,))
            top[prefix] = last[0] if last is not None else 0
        top[prefix] += 1
        return f"[{prefix}_{top[prefix]:03d}]"

    def close(self) -> None:
        pass


#: Bytes of rows that are sorted in memory, that are handed on together, and that are read of a sorted run at a time.
SORT_BYTES, OUT_BYTES, RUN_BYTES = 16 << 20, 4 << 20, 256 << 10
#: So many sorted runs are merged together.
FAN = 64
PACKED = "rows_"


def _packing() -> pa.ipc.IpcWriteOptions:
    return pa.ipc.IpcWriteOptions(compression="lz4")


def _cut(table: pa.Table, size: int, rows: int = OUT_ROWS) -> Iterator[pa.Table]:
    """The table in parts of about ``size`` bytes and at most ``rows`` rows; a row is never cut."""
    step = max(1, min(rows, table.num_rows * size // max(1, table.nbytes)))
    for at in range(0, table.num_rows, step):
        part = table.slice(at, step)
        if part.nbytes > 2 * size and part.num_rows > 1:
            yield from _cut(part, size, part.num_rows // 2)
        else:
            yield part


def _sorted(tables: list[pa.Table], by: str) -> pa.Table:
    table = pa.concat_tables(tables, promote_options="permissive")
    return table.take(pc.sort_indices(table, [(by, "ascending")])).combine_chunks()


def _unpacked(rows: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
    """Tables of rows that come as they are, or packed in Arrow's form, some thousand of a slot as one value."""
    for frame in rows:
        if PACKED not in frame.columns:
            yield pa.Table.from_pandas(frame, preserve_index=False)
            continue
        for packed in frame[PACKED]:
            with pa.ipc.open_stream(packed) as reader:
                yield reader.read_all()


def _kept(parts: Iterator[pa.Table], path: str) -> str:
    """Write sorted rows as a run, which is read some at a time."""
    writer = None
    for part in parts:
        for piece in _cut(part, RUN_BYTES):
            piece = piece.combine_chunks()
            writer = writer or pa.ipc.new_file(path, piece.schema, options=_packing())
            writer.write_table(piece)
    writer.close()
    return path


def _run(path: str) -> Iterator[pa.Table]:
    with pa.OSFile(path) as file, pa.ipc.open_file(file) as reader:
        for i in range(reader.num_record_batches):
            yield pa.Table.from_batches([reader.get_batch(i)])
    os.unlink(path)


def _merged(runs: list[Iterator[pa.Table]], by: str) -> Iterator[pa.Table]:
    """Rows of sorted runs in one order: up to the least of what the runs' present parts end with, all is there."""
    parts = [next(run, None) for run in runs]
    while any(part is not None for part in parts):
        ends = [None if part is None else part[by][-1] for part in parts]
        # Nulls and what isn't a number come last.
        known = [end for end in ends if end is not None and end.as_py() is not None and end.as_py() == end.as_py()]
        least = min(known, key=lambda end: end.as_py()) if known else None
        taken = []
        for i, part in enumerate(parts):
            if part is None:
                continue
            n = part.num_rows if least is None else pc.sum(pc.less_equal(part[by], least)).as_py() or 0
            if n:
                taken.append(part.slice(0, n))
            parts[i] = part.slice(n) if n < part.num_rows else next(runs[i], None)
        yield _sorted(taken, by)


def _together(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The rows in parts of ``OUT_ROWS``, or of fewer if they are large."""
    held, rows, size = [], 0, 0
    for table in tables:
        for part in _cut(table, OUT_BYTES):
            while part.num_rows:
                if rows and size + part.nbytes > OUT_BYTES:
                    yield pa.concat_tables(held, promote_options="permissive")
                    held, rows, size = [], 0, 0
                head = part.slice(0, OUT_ROWS - rows)
                part = part.slice(head.num_rows)
                held.append(head)
                rows, size = rows + head.num_rows, size + head.nbytes
                if rows == OUT_ROWS:
                    yield pa.concat_tables(held, promote_options="permissive")
                    held, rows, size = [], 0, 0
    if held:
        yield pa.concat_tables(held, promote_options="permissive")


def _in_order(rows: Iterator[pd.DataFrame], by: str) -> Iterator[pa.Table]:
    """All rows, sorted, some at a time. What doesn't fit into ``SORT_BYTES`` is sorted in runs on disk, which are merged."""
    with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
        names = (f"{folder}/{n}" for n in itertools.count())
        held, size, levels = [], 0, []

        def keep(parts: Iterator[pa.Table], level: int = 0) -> None:
            if level == len(levels):
                levels.append([])
            levels[level].append(_kept(parts, next(names)))
            if len(levels[level]) == FAN:
                runs, levels[level] = [_run(path) for path in levels[level]], []
                keep(_merged(runs, by), level + 1)

        for table in _unpacked(rows):
            held.append(table)
            size += table.nbytes
            if size > SORT_BYTES:
                keep(iter([_sorted(held, by)]))
                held, size = [], 0
        last = [iter(_cut(_sorted(held, by), OUT_BYTES))] if held else []
        held = []
        yield from _together(_merged([_run(path) for level in levels for path in level] + last, by))


def _replaced(text: str, found: list, known: dict[str, str]) -> str:
    """The text with its disjoint findings, in order, replaced."""
    parts, done = [], 0
    for start, end, _ in found:
        parts += (text[done:start], known[text[start:end]])
        done = end
    return "".join(parts) + text[done:]


def _frame(table: pa.Table) -> pd.DataFrame:
    """Columns stay as they are in Arrow; only nested ones become Python's."""
    return table.combine_chunks().to_pandas(types_mapper=lambda kind: None if pa.types.is_nested(kind) else pd.ArrowDtype(kind))


class _BoundedNumberer(StatefulProcessor):
    """Placeholders of the scopes of one slot, of which the ``most`` last used are remembered.

    Findings come as JSON, ``[start, end, prefix]`` in order, and texts go back redacted. A slot's rows are sorted with the help of the disk.
    """

    def __init__(self, most: int, text: str, out: str):
        self.most = most
        self.text = text
        self.out = out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "scope string, value string", "placeholder string")
        self.top = handle.getMapState("top", "scope string, prefix string", "n bigint")
        self.used = handle.getMapState("used", "scope string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {scope[0]: at[0] for scope, at in self.used.iterator()}
        # In the order of use: the first one was not used for the longest.
        used = dict(sorted(before.items(), key=lambda item: item[1]))
        clock = max(used.values(), default=0)
        # Scopes that began or began anew in this batch know nothing of what is stored under their name.
        fresh: set[str] = set()
        known: dict[str, dict[str, str]] = {}
        top: dict[str, dict[str, int]] = {}
        for part in _in_order(rows, "seq_"):
            redacted = []
            listed = json.loads(f"[{','.join(part['found_'].to_pylist())}]")
            for scope, text, spans in zip(part["scope_"].to_pylist(), part[self.text].to_pylist(), listed, strict=True):
                if scope in used:
                    del used[scope]
                else:
                    if len(used) >= self.most:
                        oldest = next(iter(used))
                        del used[oldest]
                        known.pop(oldest, None)
                        top.pop(oldest, None)
                    fresh.add(scope)
                clock += 1
                used[scope] = clock
                if scope not in known:
                    known[scope], top[scope] = {}, {}
                mine = known[scope]
                found = [(int(start), int(end), prefix) for start, end, prefix in spans]
                # The last value of a text is numbered first.
                for start, end, prefix in reversed(found):
                    if (value := text[start:end]) not in mine:
                        mine[value] = self._placeholder(scope, value, prefix, scope in fresh, top[scope])
                redacted.append(_replaced(text, found, mine) if found else text)
            slim = part.drop_columns([c for c in ("found_", "seq_", "scope_", "slot_", self.out) if c in part.column_names])
            yield _frame(slim.append_column(self.out, pa.array(redacted, pa.string())))
        self._store(before, used, fresh, known, top)

    def _placeholder(self, scope: str, value: str, prefix: str, fresh: bool, tops: dict[str, int]) -> str:
        old = None if fresh else self.known.getValue((scope, value))
        if old is not None:
            return old[0]
        if prefix not in tops:
            last = None if fresh else self.top.getValue((scope, prefix))
            tops[prefix] = last[0] if last is not None else 0
        tops[prefix] += 1
        return f"[{prefix}_{tops[prefix]:03d}]"

    def _store(self, before: dict, used: dict, fresh: set, known: dict, top: dict) -> None:
        gone = {scope for scope in before if scope not in used or scope in fresh}
        if gone:
            for state in (self.known, self.top):
                for name in [k for k in state.keys() if k[0] in gone]:
                    state.removeKey(tuple(name))
            for scope in gone.difference(used):
                self.used.removeKey((scope,))
        for scope, mine in known.items():
            for value, placeholder in mine.items():
                self.known.updateValue((scope, value), (placeholder,))
            for prefix, n in top[scope].items():
                self.top.updateValue((scope, prefix), (n,))
        for scope, at in used.items():
            if before.get(scope) != at:
                self.used.updateValue((scope,), (at,))

    def close(self) -> None:
        pass


def slot_of(scope: Column, slots: int) -> Column:
    """The slot that a scope belongs to."""
    return F.conv(F.substring(F.md5(scope.cast("binary")), 1, 8), 16, 10).cast("bigint") % slots


_WORD = (1 << 32) - 1


def _turned(x: int, by: int) -> int:
    return (x << by | x >> (32 - by)) & _WORD


def _less(x: int, factor: int) -> int:
    return x * pow(factor, -1, 1 << 32) & _WORD


def key_of(slot: int) -> int:
    """The long whose hash is the slot's number, so that Spark deals out slots evenly, to any number of partitions.

    Spark's hash is Murmur3 with seed 42; its steps are undone for a long whose lower half is 0.
    """
    h = slot & _WORD
    h = _less(h ^ h >> 16, 0xC2B2AE35)
    h = _less(h ^ h >> 13 ^ h >> 26, 0x85EBCA6B)
    h = _turned(_less((h ^ h >> 16 ^ 8) - 0xE6546B64, 5), 19)
    k = h ^ (_turned(42, 13) * 5 + 0xE6546B64) & _WORD
    k = _less(_turned(_less(k, 0x1B873593), 17), 0xCC9E2D51)
    return (k << 32) - ((k >> 31) << 64)


def _packer(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as ``slot_, rows_``: those of a slot in a batch as one value or some, each in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table.take(pc.sort_indices(table, [("slot_", "ascending"), ("seq_", "ascending")])).combine_chunks()
            slots = table["slot_"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            keys, packed = [], []
            for start, end in itertools.pairwise(cuts):
                for part in _cut(table.slice(start, end - start).select(columns), RUN_BYTES):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=_packing()) as writer:
                        writer.write_table(part)
                    keys.append(key_of(int(slots[start])))
                    packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["slot_", PACKED])

    return pack


def redact_stream_keyed(
    df: DataFrame,
    config: Config,
    *,
    scope: str,
    seq: str,
    text: str = "text",
    out: str = "redacted",
    ttl_ms: int | None = None,
    max_scopes: int | None = None,
    slots: int = 64,
) -> DataFrame:
    """Column scope with the mapping as stream state (needs the RocksDB state store).

    ``ttl_ms`` forgets values and counters that were not written for that long. A scope is
    worked on by one task per batch; for very hot scopes use ``redact_stream_to``.

    ``max_scopes`` bounds the number of remembered scopes: they are dealt out to ``slots``, and each slot, worked on by one
    task per batch, keeps its share of the bound. When another scope comes up, the one that was not used for the longest
    is forgotten; if it comes back it starts over. With one slot that is the order of use over all scopes. Rows go to their slots
    packed, so ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what a slot's task takes at a time; a few MB are enough.
    """
    if max_scopes is not None and (ttl_ms is not None or max_scopes < slots):
        raise ValueError("max_scopes goes without ttl_ms, and is at least the number of slots")
    found = spanned(df, config, text).withColumn("scope_", scope_column(scope)).withColumn("seq_", F.col(seq))
    if max_scopes is not None:
        listed = F.transform("spans", lambda x: F.array(x.start.cast("string"), x.end.cast("string"), x.prefix))
        slotted = found.withColumn("found_", F.to_json(listed)).drop("spans").withColumn("slot_", slot_of(F.col("scope_"), slots))
        kept = [field for field in df.schema.fields if field.name != out]
        packed = slotted.mapInArrow(_packer([f.name for f in kept] + ["scope_", "seq_", "found_"]), f"slot_ bigint, {PACKED} binary")
        return packed.groupBy("slot_").transformWithStateInPandas(
            _BoundedNumberer(max_scopes // slots, text, out),
            T.StructType([*kept, T.StructField(out, T.StringType())]),
            outputMode="Append",
            timeMode="None",
        )
    keyed = found.withColumn("values_", F.to_json(values_of("spans"))).drop("spans")
    result = T.StructType([*df.schema.fields, T.StructField("edits", T.StringType())])
    numbered = keyed.groupBy("scope_").transformWithStateInPandas(
        _Numberer(ttl_ms), result, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    return apply_edits(numbered.withColumn("edits", F.from_json("edits", EDITS)), text, out)
