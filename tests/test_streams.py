import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkveil import Config, find, redact, redact_documents
from inkveil.operators import audit
from inkveil.sources.versions import VersionedStore
from inkveil.streaming import streams

SCHEMA = "doc_id bigint, team string, text string"


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, f"t{i % 3}", f"u{i % 11}@x.com from 10.0.0.{i % 4} user=bob{i}") for i in range(60)]

    def put(part, low, high):
        df = spark.createDataFrame([r for r in rows if low <= r[0] < high], SCHEMA)
        df.coalesce(1).write.parquet(f"{folder}/part{part}")

    put(0, 0, 30)
    return folder, put, spark.createDataFrame(rows, SCHEMA)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(f"{folder}/*")


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def pairs(df):
    return sorted((r.doc_id, r.redacted) for r in df.collect())


def test_document_scope(spark, source, tmp_path):
    folder, put, everything = source
    out = str(tmp_path / "out")
    for step in range(2):
        done = streams.redact_stream(stream(spark, folder), Config()).select("doc_id", "redacted")
        run(done.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")))
        if step == 0:
            put(1, 30, 60)
    assert pairs(spark.read.parquet(out)) == pairs(redact_documents(everything, Config()))


@pytest.mark.parametrize("scope", ["global", "team"])
def test_stored_mapping_with_restart(spark, source, tmp_path, scope):
    folder, put, everything = source
    out, store = str(tmp_path / "out"), VersionedStore(spark, str(tmp_path / "store"))
    for step in range(2):
        run(
            streams.redact_stream_to(
                stream(spark, folder), Config(), path=out, store=store, checkpoint=str(tmp_path / "ck"), doc="doc_id", scope=scope
            )
        )
        if step == 0:
            put(1, 30, 60)
    batch = redact(everything, Config(), doc="doc_id", scope=scope)
    assert pairs(spark.read.parquet(out)) == pairs(batch.redacted)
    assert sorted(map(tuple, store.load().collect())) == sorted(map(tuple, batch.mapping.collect()))


def test_state_with_restart(spark, source, tmp_path):
    folder, put, everything = source
    out = str(tmp_path / "out")
    for step in range(2):
        done = streams.redact_stream_keyed(stream(spark, folder), Config(), scope="team", seq="doc_id")
        done = done.select("doc_id", "redacted")
        run(done.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")))
        if step == 0:
            put(1, 30, 60)
    assert pairs(spark.read.parquet(out)) == pairs(redact(everything, Config(), doc="doc_id", scope="team").redacted)


def test_restore(spark, source, tmp_path):
    folder, put, everything = source
    batch = redact(everything, Config(), doc="doc_id")
    batch.redacted.select("doc_id", "redacted").write.parquet(str(tmp_path / "red"))
    back = spark.readStream.schema("doc_id bigint, redacted string").parquet(str(tmp_path / "red"))
    run(
        streams.restore_stream_to(
            back, batch.mapping, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"), doc="doc_id", text="redacted"
        )
    )
    got = sorted((r.doc_id, r.restored) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.doc_id, r.text) for r in everything.collect())


def test_restoring_follows_the_store(spark, source, tmp_path):
    """Placeholders that the second batch mentions were committed after the restoring stream began."""
    folder, put, everything = source
    out, store = str(tmp_path / "red"), VersionedStore(spark, str(tmp_path / "store"))
    for step in range(2):
        run(streams.redact_stream_to(stream(spark, folder), Config(), path=out, store=store, checkpoint=str(tmp_path / "ck"), doc="doc_id", scope="team"))
        back = spark.readStream.schema("doc_id bigint, team string, redacted string").option("recursiveFileLookup", True).parquet(out)
        run(streams.restore_stream_to(back, VersionedStore(spark, store.path), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck2"), doc="doc_id", scope="team", text="redacted"))
        if step == 0:
            put(1, 30, 60)
    got = sorted((r.doc_id, r.restored) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.doc_id, r.text) for r in everything.collect())


def test_bounded_scopes(spark, tmp_path):
    """The scope that was not used for the longest goes; what comes back starts over, also after a restart."""
    teams = [str(int(c)) for c in "0120310244401205432100152"]
    rows = [(i, t, f"10.0.0.{i % 3} 10.1.{t}.{i % 2} x") for i, t in enumerate(teams)]
    want, kept = {}, {}
    for i, t, text in rows:
        if t not in kept and len(kept) == 3:
            del kept[min(kept, key=lambda k: kept[k][0])]
        known = kept.setdefault(t, [0, {}])
        known[0] = i + 1
        new = text
        for v in sorted(text.split()[:2], key=text.index, reverse=True):
            known[1].setdefault(v, f"[IP_{len(known[1]) + 1:03d}]")
            new = new.replace(v, known[1][v])
        want[i] = new
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(3):
        part = rows[step * 9 : step * 9 + 9]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{step}")
        done = streams.redact_stream_keyed(stream(spark, folder), Config(), scope="team", seq="doc_id", max_scopes=3, slots=1)
        done = done.select("doc_id", "redacted")
        run(done.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")))
    assert dict(pairs(spark.read.parquet(out))) == want
    with pytest.raises(ValueError):
        streams.redact_stream_keyed(stream(spark, folder), Config(), scope="team", seq="doc_id", max_scopes=3)


def test_counts_survive_a_restart_and_a_replay(spark, source, tmp_path):
    folder, put, everything = source
    out, mark = tmp_path / "out", tmp_path / "ck"
    go = lambda: run(streams.count_stream_to(stream(spark, folder), Config(), path=str(out), checkpoint=str(mark), keys=("team",)))
    go()
    put(1, 30, 60)
    go()
    want = audit.stats(find(everything, Config(), ["team"]), "team")
    same = lambda: sorted(map(tuple, streams.counted(spark, str(out)).collect())) == sorted(map(tuple, want.collect()))
    assert same()
    # As after a crash before the last batch was noted as done.
    last = max((p for p in (mark / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert same()


def test_state_of_a_scope_is_one_call_each_way():
    """Values of a scope are read and added to together, however many there are."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, {}

        def __getattr__(self, call):
            def run(*args):
                calls.append(call)
                if call == "appendList":
                    self.rows.update(args[0])
                return {"exists": bool(self.rows), "get": iter(self.rows.items()), "getValue": None}.get(call)

            return run

    class Handle:
        def getListState(self, name, *rest):
            return State(name)

        getMapState = getListState

    one = streams._Numberer(None)
    one.init(Handle())
    for lap in range(2):
        calls.clear()
        values = [json.dumps([{"value": f"v{i}\x00\u00e9", "last": 3, "prefix": "IP", "at": [{"start": 3, "end": 5}]}]) for i in range(500)]
        rows = pd.DataFrame({"doc_id": range(500), "seq_": range(500), "scope_": "a", "values_": values})
        done = pd.concat(list(one.handleInputRows(None, iter([rows]), None)))
        assert [json.loads(e)[0]["replacement"] for e in done["edits"]] == [f"[IP_{i:03d}]" for i in range(1, 501)]
        assert len(calls) < 8


def test_a_slot_gives_redacted_texts_in_parts():
    """Rows of a slot leave in order and in parts, with the replacements made where the placeholders are known."""

    class State:
        def __getattr__(self, call):
            return lambda *args: iter(()) if call in ("iterator", "keys") else None

    class Handle:
        def getMapState(self, *args):
            return State()

    one = streams._BoundedNumberer(2, "text", "redacted")
    one.init(Handle())
    n = streams.OUT_ROWS + 5
    found = json.dumps([["0", "1", "IP"], ["2", "3", "IP"]])
    rows = pd.DataFrame({"doc_id": range(n), "text": "\u00e9 b c", "seq_": range(n), "scope_": [f"s{i % 2}" for i in range(n)], "slot_": 0, "found_": found})
    rows.loc[3, ["text", "found_"]] = [None, "[]"]
    mixed = rows.sample(frac=1, random_state=1)
    parts = list(one.handleInputRows(None, iter([mixed[: n // 2], mixed[n // 2 :]]), None))
    assert [len(p) for p in parts] == [streams.OUT_ROWS, 5]
    done = pd.concat(parts, ignore_index=True)
    assert list(done["doc_id"]) == list(range(n)) and set(done.columns) == {"doc_id", "text", "redacted"}
    assert pd.isna(done["redacted"][3]) and set(done["redacted"].drop(3)) == {"[IP_002] [IP_001] c"}


def test_rows_of_small_files_are_dealt_out(spark, tmp_path, monkeypatch):
    """Files are packed into tasks by bytes; a micro-batch has tasks of bounded rows all the same."""
    from inkveil.sources import tables

    folder, tasks = str(tmp_path / "in"), []
    spark.range(0, 40_000, 1, 12).write.parquet(folder)
    at_rest = spark.read.parquet(folder)
    monkeypatch.setattr(tables, "TASK_ROWS", 2_000)
    coming = tables.spread_stream(spark.readStream.schema(at_rest.schema).parquet(folder), at_rest, "id")

    def step(batch, _):
        tasks.extend(batch.groupBy(F.spark_partition_id()).count().collect())

    run(coming.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "mark")))
    assert sum(n for _, n in tasks) == 40_000
    assert len(tasks) == 20 and max(n for _, n in tasks) < 3_000


def test_a_slot_is_sorted_on_disk(monkeypatch, tmp_path):
    """More rows than are held leave in order all the same, packed or not, and nothing stays on the disk."""
    import pyarrow as pa

    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(streams, "SORT_BYTES", 4_000)
    monkeypatch.setattr(streams, "RUN_BYTES", 1_000)
    monkeypatch.setattr(streams, "OUT_BYTES", 2_000)
    monkeypatch.setattr(streams, "FAN", 3)
    n, most = 3_000, []
    rows = pd.DataFrame({"at": pd.date_range("2024-01-01", periods=n, tz="UTC"), "text": [f"{i} \u00e9" * (i % 7 + 1) for i in range(n)], "seq_": range(n)})
    rows.loc[5, "text"] = None
    mixed = rows.sample(frac=1, random_state=2).reset_index(drop=True)
    runs = [mixed[i : i + 100] for i in range(0, n, 100)]
    pack = streams._packer(["at", "text", "seq_"])
    batches = [pa.RecordBatch.from_pandas(r.assign(slot_=[i % 2 for i in r["seq_"]]), preserve_index=False) for r in runs]
    packed = [b.to_pandas() for b in pack(iter(batches))]
    assert {len(p) for p in packed} != {1} and {k for p in packed for k in p["slot_"]} == {streams.key_of(0), streams.key_of(1)}
    sorting = streams._sorted
    monkeypatch.setattr(streams, "_sorted", lambda tables, by: most.append(sum(t.nbytes for t in tables)) or sorting(tables, by))
    for given in (runs, packed):
        done = list(streams._in_order(iter(given), "seq_"))
        whole = pa.concat_tables(done).to_pandas()
        assert list(whole["seq_"]) == list(range(n)) and list(whole["at"]) == list(rows["at"]) and list(whole["text"].fillna("")) == list(rows["text"].fillna(""))
        assert max(t.nbytes for t in done) < 5_000 and max(most) < 30_000
    assert list(tmp_path.iterdir()) == []
    nulls = pd.DataFrame({"seq_": [3.0, None, 1.0, float("nan"), 2.0] * 400, "x": range(2000)})
    ordered = pa.concat_tables(streams._in_order(iter([nulls[i : i + 50] for i in range(0, 2000, 50)]), "seq_")).to_pandas()
    assert ordered["seq_"][:1200].tolist() == [1.0] * 400 + [2.0] * 400 + [3.0] * 400 and ordered["seq_"][1200:].isna().all() and sorted(ordered["x"]) == list(range(2000))
    assert list(streams._in_order(iter([]), "seq_")) == []


def test_slots_go_to_partitions_evenly(spark):
    """Slots share a task only if there are more of them than tasks, whatever the number of partitions."""
    keys = [streams.key_of(slot) for slot in range(200)]
    hashes = [r.h for r in spark.createDataFrame([(k,) for k in keys], "slot_ bigint").selectExpr("hash(slot_) AS h").collect()]
    assert hashes == list(range(200))


def test_columns_keep_their_types_through_a_slot(spark, tmp_path):
    """Large numbers beside nulls, decimals, times and nested values leave a bounded stream as they came."""
    schema = "doc_id bigint, team string, text string, big bigint, price decimal(20,4), at timestamp, day date, raw binary, tags array<string>, pair struct<a:int,b:string>, flag boolean"
    rows = spark.range(40).selectExpr(
        "id AS doc_id", "concat('t', id % 5) AS team", "concat('10.0.0.', id) AS text", "if(id % 3 = 0, null, 9007199254740993 + id) AS big",
        "if(id % 4 = 0, null, cast(id AS decimal(20,4)) / 7) AS price", "timestamp_seconds(1700000000.25 + id) AS at", "if(id % 2 = 0, null, date'2024-02-29') AS day",
        "cast(concat('x', id) AS binary) AS raw", "if(id % 5 = 0, null, array('a', cast(id AS string))) AS tags",
        "named_struct('a', cast(id AS int), 'b', cast(null AS string)) AS pair", "if(id % 6 = 0, null, id % 2 = 0) AS flag",
    )
    rows = spark.createDataFrame(rows.selectExpr("*").collect(), schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    coming = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    done = streams.redact_stream_keyed(coming, Config(), scope="team", seq="doc_id", max_scopes=4, slots=2)
    run(done.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.drop("redacted").collect())) == sorted(map(str, rows.collect()))
    assert back.where("redacted like '[IP_0%]'").count() == 40
