import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inkveil import Config, compare_presets, find, preview, redact, redact_documents, restore
from inkveil import catalog
from inkveil.operators import mapping as maps
from inkveil.sources import files, mapping_files, presets, session, tables


def found(df, config):
    return sorted((r.type, r.value) for r in find(df, config, ["doc_id"]).collect())


def test_preserve_is_a_substring_test_without_case(docs):
    config = Config.of(preserve=["127.0.0.1", "ACME"])
    assert found(docs("127.0.0.10 10.0.0.1 x@acme.com"), config) == [("ipv4", "10.0.0.1")]


def test_preserved_outer_frees_the_inner(docs):
    assert found(docs("https://h.example.com/keep"), Config.of(preserve=["/keep"])) == [("hostname", "h.example.com")]


def test_custom_prefix(docs):
    base = Config().add_custom_pattern(r"SRV-[A-Z0-9]+", "SERVER")
    assert redact_documents(docs("SRV-9"), base).first().redacted == "[VAL_001]"
    declared = Config.of(custom=[(r"SRV-[A-Z0-9]+", "SERVER")], custom_prefix="declared")
    assert redact_documents(docs("SRV-9"), declared).first().redacted == "[SERVER_001]"


def test_custom_groups_first_that_took_part(docs):
    config = Config.of([], custom=[(r"a=(\d+)|b=(?P<w>\w+)", "X")])
    assert found(docs("a=12 b=zz A=3"), config) == [("custom", "12"), ("custom", "3"), ("custom", "zz")]


def test_custom_named_group_and_order(docs):
    config = Config.of([], custom=[(r"id-[0-9]+", "A"), (r"id-[0-9]+x", "B")])
    assert found(docs("id-12x id-3"), config) == [("custom", "id-12x"), ("custom", "id-3")]


def test_bad_custom_patterns_fail_early():
    with pytest.raises(Exception):
        Config().add_custom_pattern("(", "X")
    with pytest.raises(ValueError):
        Config().add_custom_pattern("a*", "X")


def test_presets(docs):
    text = "550e8400-e29b-41d4-a716-446655440000 PLAY [web] 10.0.0.1 127.0.0.1"
    kubernetes = redact_documents(docs(text), Config.of(preset="kubernetes")).first().redacted
    assert kubernetes == "[VAL_001] PLAY [web] [IP_002] [IP_001]"
    ansible = redact_documents(docs(text), Config.of(preset="ansible")).first().redacted
    assert ansible.endswith("PLAY [[VAL_001]] [IP_001] 127.0.0.1")
    with pytest.raises(ValueError):
        Config.of(preset="unknown")


def test_compare_presets_equals_each_preset_alone(docs):
    df = docs(*["i-0123456789 a@amazonaws.com 10.0.0.1 TASK [x y] localhost pod/a-1 a-b-c-d-e", "vpc-12 mysql://x/y u=bob"])
    together = compare_presets(df, catalog.PRESETS, ["doc_id"]).collect()
    for preset in catalog.PRESETS:
        alone = find(df, Config().load_preset(preset), ["doc_id"]).collect()
        mine = [r for r in together if r.preset == preset["id"]]
        assert sorted((r.doc_id, r.type, r.start, r.end) for r in mine) == sorted((r.doc_id, r.type, r.start, r.end) for r in alone)


def test_preset_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "patterns": ["IPV4", "nope"], "custom_patterns": [{"regex": "x+"}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"id": "bb", "patterns": ["email"], "preserve": ["x"]}))
    (tmp_path / "c.json").write_text("{broken")
    known = presets.load_presets(spark, str(tmp_path))
    assert set(known) == {"a", "bb"}
    config = Config.of(preset="a", presets=known)
    assert config.types == {"ipv4"} and config.custom == ()
    assert Config.of(preset="bb", presets=known).preserve == ("x",)
    assert presets.preset_table(spark).count() == 8


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("a\r\nSRV-A : ok=0\rb é".encode())
    whole = files.read_documents(spark, str(tmp_path)).collect()
    assert [r.text for r in whole] == ["a\nSRV-A : ok=0\nb é"]
    lines = files.read_documents(spark, str(tmp_path), unit="line").collect()
    assert len(lines) == 3


def test_read_uploads(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é\r\n".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    accepted, rejected = files.read_uploads(spark, str(tmp_path), cap=50)
    assert sorted(r.text for r in accepted.collect()) == ["é", "é\r\n"]
    assert [r.length for r in rejected.collect()] == [100]


def test_write_redacted(spark, docs, tmp_path):
    done = redact_documents(docs("a@x.com", "z"), Config())
    files.write_redacted(done, str(tmp_path / "t"), "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["[EMAIL_001]", "z"]
    files.write_redacted(done, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def sample(spark, rows):
    return spark.createDataFrame(rows, maps.empty_mapping(spark).schema)


def test_export_and_import(spark, tmp_path):
    m = sample(spark, [("", f"10.0.0.{i}", f"[IP_{i:03d}]", "IP", i, i, 0) for i in (1, 101, 1000)] + [("", "a\"b", "[VAL_001]", "VAL", 1, 5, 0)])
    rows = mapping_files.export_json(m).orderBy("shard").collect()
    assert len(rows) == 1
    body = json.loads(rows[0].json)
    assert body["counters"] == {"IP": 1000, "VAL": 1}
    assert body["mappings"]['a"b'] == "[VAL_001]" and body["reverse_mappings"]["[IP_101]"] == "10.0.0.101"
    assert len(mapping_files.export_json(m, shard_rows=100).collect()) == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.json").write_text(rows[0].json)
    (tmp_path / "in" / "empty.json").write_text("{}")
    (tmp_path / "in" / "bad.json").write_text("{nope")
    entries, rejected = mapping_files.import_json(spark, str(tmp_path / "in"))
    got = {(r.value, r.placeholder, r.prefix, r.n) for r in entries.collect()}
    assert got == {(r.value, r.placeholder, r.prefix, r.n) for r in m.collect()}
    assert [r.file.rsplit("/", 1)[1] for r in rejected.collect()] == ["bad.json"]


def test_import_without_counters_does_not_start_over(spark, docs, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"mappings": {"10.0.0.1": "[IP_007]"}}))
    entries, _ = mapping_files.import_json(spark, str(tmp_path))
    result = redact(docs("10.0.0.1 10.0.0.2"), Config(), doc="doc_id", existing=entries)
    assert result.redacted.first().redacted == "[IP_007] [IP_008]"


def test_text_export_orders_by_placeholder(spark, tmp_path):
    m = sample(spark, [("", "a", "[IP_101]", "IP", 101, 0, 0), ("", "b", "[IP_1000]", "IP", 1000, 1, 0)])
    mapping_files.write_text(m, str(tmp_path / "out"))
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["# Mapping Table (Placeholder -> Original)", "=" * 60, "[IP_1000] -> b", "[IP_101] -> a"]


def test_session_round_trip(spark, docs, tmp_path):
    config = Config.of(["ipv4", "email"], custom=[("x-[0-9]+", "X")], preserve=["keep"])
    m = redact(docs("10.0.0.1"), config, doc="doc_id").mapping
    session.save_session(spark, config, m, str(tmp_path))
    back, entries = session.load_session(spark, str(tmp_path), m.schema["first_seq"].dataType)
    assert back == config
    assert entries.first().placeholder == "[IP_001]"
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "s.json").write_text(json.dumps({"enabled_patterns": {"ipv4": False}}))
    assert session.load_settings(spark, str(tmp_path / "old")).types == frozenset(catalog.TYPE_NAMES) - {"ipv4"}


def test_store_replay_forget_compact(spark, tmp_path):
    store = session.MappingStore(spark, str(tmp_path / "s"))
    assert store.load().count() == 0
    one = sample(spark, [("a", "v", "[IP_001]", "IP", 1, 0, 0), ("b", "v", "[IP_001]", "IP", 1, 0, 0)])
    two = sample(spark, [("a", "w", "[IP_002]", "IP", 2, 1, 0)])
    store.append(one, 0)
    store.append(one, 0)
    store.append(two, 1)
    assert store.load().count() == 3 and store.load(before=1).count() == 2
    store.compact(0)
    assert store.load().count() == 3
    store.forget(["a"], 0)
    assert sorted((r.scope, r.value) for r in store.load().collect()) == [("a", "w"), ("b", "v")]
    store.compact(1)
    assert sorted((r.scope, r.value) for r in store.load().collect()) == [("a", "w"), ("b", "v")]


def test_forgetting_twice_in_a_batch_forgets_both(spark, tmp_path):
    store = session.MappingStore(spark, str(tmp_path / "s"))
    store.append(sample(spark, [(s, "v", "[IP_001]", "IP", 1, 0, 0) for s in "abc"]), 0)
    for scope in "aba":
        store.forget([scope], 0)
    assert [r.scope for r in store.load().collect()] == ["c"]


def test_exports_keep_their_scopes(spark, tmp_path):
    scopes = ["a", "b c", "x/y=z%+é", ""]
    m = sample(spark, [(s, "v", "[IP_001]", "IP", 1, 0, 0) for s in scopes] + [("a", "w", "[IP_002]", "IP", 2, 1, 0)])
    mapping_files.write_json(m, str(tmp_path / "objects"))
    entries, rejected = mapping_files.import_json(spark, str(tmp_path / "objects"))
    assert rejected.count() == 0
    assert sorted((r.scope, r.value, r.placeholder) for r in entries.collect()) == sorted((r.scope, r.value, r.placeholder) for r in m.collect())
    mapping_files.write_entries(m, str(tmp_path / "lines"))
    assert sorted(mapping_files.read_entries(spark, str(tmp_path / "lines")).collect()) == sorted(m.collect())


def test_large_exports_have_the_same_form(spark, tmp_path):
    many = spark.range(60_000).selectExpr(
        "'' AS scope", "concat('v', id) AS value", "concat('[IP_', lpad(id + 1, 3, '0'), ']') AS placeholder", "'IP' AS prefix",
        "id + 1 AS n", "id AS first_seq", "0 AS first_pos",
    )
    assert mapping_files.export_json(many).count() == 1
    mapping_files.write_entries(many, str(tmp_path / "lines"))
    back = mapping_files.read_entries(spark, str(tmp_path / "lines"))
    assert back.exceptAll(many).count() == 0 and back.count() == 60_000


def test_uploads_have_no_cap_by_default(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    accepted, rejected = files.read_uploads(spark, str(tmp_path))
    assert accepted.count() == 1 and rejected.count() == 0


def test_lines_sort_in_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"10.0.0.{i}\n" for i in range(12)))
    done = redact(files.read_documents(spark, str(tmp_path), unit="line"), Config(), doc="doc_id")
    assert {r.value: r.placeholder for r in done.mapping.collect()} == {f"10.0.0.{i}": f"[IP_{i + 1:03d}]" for i in range(12)}


def test_a_run_leaves_nothing_behind(spark, docs):
    from pathlib import Path

    from inkveil.functions.lineage import scratch_folder, scratch_run

    with scratch_run(spark) as folder:
        done = redact(docs("10.0.0.1", "a@x.com"), Config(), doc="doc_id")
        assert restore(done.redacted.select("doc_id", F.col("redacted").alias("text")), done.mapping, "doc_id").count() == 2
        assert any(Path(folder).iterdir())
    assert not Path(folder).exists() and Path(scratch_folder(spark)).exists()


def test_preview_escapes(docs):
    html = preview(docs("<b> & 10.0.0.1\n\"x'"), Config()).first().html
    assert html.startswith("&lt;b&gt;&nbsp;&amp;&nbsp;<span class=\"detection\" data-type=\"ipv4\" style=\"background-color: #ff6b6b20;")
    assert html.endswith('title="IPV4">10.0.0.1</span><br>&quot;x&#39;')


def test_sql_functions(spark, docs):
    from inkveil.functions import sqlfuncs

    sqlfuncs.register(spark, Config.of(["email", "ipv4"]))
    docs("a@x.com 10.0.0.1 a@x.com", None).createOrReplaceTempView("t")
    rows = spark.sql("SELECT doc_id, redact_text(text) AS r, size(sensitive_findings(text)) AS n FROM t ORDER BY doc_id").collect()
    assert [(r.r, r.n) for r in rows] == [("[EMAIL_001] [IP_001] [EMAIL_001]", 3), (None, 0)]
    assert spark.sql("SELECT is_card_value('4111 1111 1111 1111') AND NOT is_phone_value('123')").first()[0]
    assert spark.sql("SELECT is_preserved_value('LOCALHOST:1', array('localhost'))").first()[0]


def test_table_function(spark, docs):
    from inkveil.functions import sqlfuncs

    sqlfuncs.register(spark, Config.of(["email", "ipv4", "hostname"], custom=[("x-[0-9]+", "X")]))
    docs("a@x.com 10.0.0.1 x-7", None).createOrReplaceTempView("t")
    ask = lambda kinds: spark.sql(f"SELECT f.type, f.value FROM t, LATERAL findings_of(text{kinds}) AS f ORDER BY f.start")
    every = [("email", "a@x.com"), ("ipv4", "10.0.0.1"), ("custom", "x-7")]
    assert [tuple(r) for r in ask("").collect()] == every and [tuple(r) for r in ask(", NULL").collect()] == every
    # What the e-mail covered comes up; types that were not registered stay out.
    assert [r.value for r in ask(", array('hostname', 'date')").collect()] == ["x.com"]
    assert [r.type for r in ask(", array('custom')").collect()] == ["custom"]


def test_restoring_reads_its_input_once(spark, docs):
    from inkveil.functions.lineage import written

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    done = redact(docs("10.0.0.1", "none", "a@x.com"), Config(), doc="doc_id")
    texts = written(done.redacted.select("doc_id", "redacted")).select("doc_id", counted("redacted").alias("text"))
    back = restore(texts, done.mapping, "doc_id").select("doc_id", "restored")
    assert sorted(map(tuple, back.collect())) == [(0, "10.0.0.1"), (1, "none"), (2, "a@x.com")] and seen.value == 3


def test_registered_exports_write_bounded_objects(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from checks import queries

    monkeypatch.setattr(mapping_files, "SHARD_ROWS", 2, raising=False)
    rows = [(s, f"v{i}", f"[IP_{i:03}]", "IP", i, i, 0) for s in ("a", "b c") for i in range(1, 6)]
    table = spark.createDataFrame(rows, maps.empty_mapping(spark).schema)
    monkeypatch.setattr(queries, "stored", lambda *_: (str(tmp_path / "out"), table))
    monkeypatch.setattr(queries, "log_redaction", lambda *_: SimpleNamespace(mapping=table))
    back = queries.import_scopes(spark, "")
    assert sorted(back.collect()) == sorted(table.select(*back.columns).collect())
    assert len(list(tmp_path.glob("out/scope=*/shard=*/part-*"))) == 6
    objects = queries.queries()["export_json"](spark, "").collect()
    assert len(objects) == 6 and all(len(json.loads(o.json)["mappings"]) <= 2 for o in objects)


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """A file of one row group has as many splits as there are cores, of which one holds all rows."""
    path = str(tmp_path / "t")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() > 4
        rows = [r["count"] for r in tables.read_table(spark, path, "id").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 20_000 and len(rows) == 8 and max(rows) < 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(0, 20_000, 1, 6)
    assert tables.spread(even, "id") is even
    assert tables.parts_needed(spark.range(0, 2_000_000, 1, 4)) == 20
    assert tables.spread(spark.createDataFrame([], "id int"), "id").count() == 0


def test_a_file_for_every_value_is_listed_in_few_tasks(spark, tmp_path):
    """Files are dealt out evenly, and their folders are not listed one by a task."""
    path = str(tmp_path / "files")
    lines = spark.range(1200).selectExpr("id % 300 AS user", "concat('line ', id) AS text")
    files.write_files(lines, path, "user")
    asked = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    group = "listing of files"
    spark.sparkContext.setJobGroup(group, group)
    try:
        read = files.read_documents(spark, path)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(s.numTasks <= 8 * spark.sparkContext.defaultParallelism for s in stages)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == asked
    rows = {r.doc_id.split("user=")[1].split("/")[0]: r.text for r in read.collect()}
    assert len(rows) == 300 and all(sorted(int(t[5:]) % 300 for t in v.split("\n") if t) == [int(k)] * 4 for k, v in rows.items())


def test_files_are_written_as_spark_writes_them(spark, tmp_path):
    """The same folders and files, without processes started for each of them."""
    values = ["a b", "a/b", "x=y", "é", "%41", "", None, "q\"'", "[z]", "{z}", "^", "a:b", "a*?", "\\b", "\x01\x7f", "..", "new\nline", "~&<>|"]
    lines = spark.createDataFrame([(v, t) for v in values for t in ("one é", "two\r\nthree", None, "")], "k string, text string")
    lines.repartition(4, F.coalesce("k", F.lit(""))).write.partitionBy("k").text(str(tmp_path / "spark"))
    files.write_files(lines, str(tmp_path / "own"), "k")

    def held(top):
        found = sorted((f.parent.name, sorted(f.read_bytes().split(b"\n"))) for f in top.rglob("part-*"))
        return found, (top / "_SUCCESS").exists(), [f for f in top.rglob(".part-*") if not f.name.endswith(".crc")]

    assert held(tmp_path / "own") == held(tmp_path / "spark") and len(held(tmp_path / "own")[0]) == 17
    with pytest.raises(AnalysisException):
        files.write_files(lines, str(tmp_path / "own"), "k")

    def started():
        return next(int(row.split()[1]) for row in open("/proc/stat") if row.startswith("processes"))

    many = spark.range(4000).selectExpr("id % 1000 AS user", "concat('line ', id) AS text")
    before = started()
    files.write_files(many, str(tmp_path / "many"), "user")
    assert started() - before < 1000
    assert spark.read.text(str(tmp_path / "many")).where("user = cast(substring(value, 6) AS int) % 1000").count() == 4000


def test_small_files_are_dealt_out(spark, tmp_path):
    """Tasks that would hold few small files each are some by size; names of folders make no columns."""
    lines = spark.range(1200).selectExpr("id % 300 AS user", "concat('line ', id) AS text")
    path, flat = str(tmp_path / "files"), tmp_path / "flat"
    files.write_files(lines, path, "user")
    flat.mkdir()
    (flat / "a=b.txt").write_text("one\n")
    (flat / "deep").mkdir()
    (flat / "deep" / "c.txt").write_text("two\n")
    assert files.in_value_folders(spark, path) and not files.in_value_folders(spark, str(flat))
    assert [r.text for r in files.read_documents(spark, str(flat), unit="line").collect()] == ["one"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        by_line, accepted = files.read_documents(spark, path, unit="line"), files.read_uploads(spark, path)[0]
        assert by_line.rdd.getNumPartitions() == accepted.rdd.getNumPartitions() == files.read_documents(spark, path).rdd.getNumPartitions() == 16
        rows = by_line.collect()
        texts = accepted.collect()
        rejected = files.read_uploads(spark, path, cap=1)[1]
        assert rejected.rdd.getNumPartitions() == 16 and rejected.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.text for r in rows) == sorted(f"line {i}" for i in range(1200)) and len({r.doc_id for r in rows}) == 1200
    assert sorted("".join(r.text for r in texts).split("\n")[:-1]) == sorted(r.text for r in rows)
    whole = {r.doc_id: r.text for r in texts}
    for name in whole:
        of = sorted((r.doc_id, r.text) for r in rows if r.doc_id.startswith(name.replace("file:///", "file:/")) or r.doc_id.startswith(name.replace("file:/", "file:///", 1)))
        assert "".join(f"{t}\n" for _, t in of) == whole[name]
