"""The Spark queries that the driver runs, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import planted
from inkveil import Config, catalog, compare_presets, find, preview, redact, redact_documents, restore
from inkveil.functions import sqlfuncs, validators
from inkveil.functions.lineage import scratch_folder
from inkveil.operators import audit, domains, mapping as maps, scored
from inkveil.plans.pipelines import redact_into, spanned
from inkveil.sources import mapping_files
from inkveil.sources.files import read_documents, read_uploads, write_files, write_redacted
from inkveil.sources.large_files import find_in_files
from inkveil.sources.presets import load_presets, preset_table
from inkveil.sources.session import MappingStore, load_session, save_session
from inkveil.sources.tables import read_table, spread_stream
from inkveil.sources.versions import VersionedStore
from inkveil.streaming import streams

SPAN = ("type", "value", "start", "end")

TOKEN = r'token = "([0-9a-f]{40})"'
TOKEN_TYPES = ("email", "ipv4", "credit_card")
PRESERVE = ("example.com", "10.")
REDACT_TYPES = ("email", "ipv4", "hostname", "phone", "credit_card")
LOG_TYPES = tuple(kind for kind, _ in planted.SERVICE_LOG)

AWS_LINE = (
    "concat('call arn:aws:s3:eu-west-1:', lpad(cast(k as varchar(20)), 12, '0'), ':bucket/b', cast(k as varchar(20)), "
    "' from i-', lpad({hex(k)}, 8, '0'), ' in vpc-', {hex(k % 4096)}, ' to s', cast(k % 50 as varchar(9)), '.amazonaws.com')"
)

SUFFIXES = (
    ("com", False),
    ("org", False),
    ("net", False),
    ("fr", False),
    ("io", False),
    ("uk", False),
    ("co.uk", False),
    ("github.io", True),
    ("*.ck", False),
    ("!www.ck", False),
)

HOST = (
    "case page_id % 8 when 0 then concat('www.shop', cast(page_id as varchar(20)), '.co.uk') "
    "when 1 then concat('user', cast(page_id as varchar(20)), '.github.io') "
    "when 2 then concat('a.b', cast(page_id as varchar(20)), '.foo.ck') "
    "when 3 then 'www.ck' "
    "when 4 then concat('ab', cast(page_id % 10 as varchar(20)), '.internal') "
    "when 5 then 'uk' "
    "when 6 then 'x.org' "
    "else split_part(url, '/', 3) end"
)


KEYS = {"documents": "doc_id", "pages": "page_id", "events": "event_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_table(spark, path, KEYS[name]) if name in KEYS else spark.read.parquet(path)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.col("event_id"))


def service_logs(spark: SparkSession, sf: str) -> DataFrame:
    line = planted.line_sql(planted.SERVICE_LOG, "spark")
    return events(spark, sf).selectExpr("event_id", "user_id", f"{line} AS text")


def suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUFFIXES), "rule string, private boolean")


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", f"{HOST} AS host")


# --- findings -------------------------------------------------------------------------


def find_planted(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        logs = events(spark, sf).selectExpr("event_id", f"{planted.text_sql(kind, 'spark')} AS text")
        return find(logs, Config(), ["event_id"]).select("event_id", *SPAN)

    return run


def find_in(source: str, key: str, text: str, types=None, preserve=()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        config = Config.of(types, preserve=preserve)
        return find(table(spark, sf, source), config, [key], text).select(key, *SPAN)

    return run


def luhn_orders(spark: SparkSession, sf: str) -> DataFrame:
    number = table(spark, sf, "orders").selectExpr("o_orderkey", "concat('4', lpad(cast(o_orderkey as string), 15, '0')) AS number")
    return number.select("o_orderkey", validators.is_card("number").alias("is_card"))


def phone_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Phone check over keys spelled with separators, of 7 to 10 digits."""
    number = table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat('+1 ', lpad(cast(c_custkey as string), 6 + c_custkey % 4, '0')) AS number"
    )
    return number.select("c_custkey", validators.is_phone("number").alias("is_phone"))


# --- overlaps ---------------------------------------------------------------------------


def overlap_case(text: str, **config) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        logs = events(spark, sf).selectExpr("event_id", f"{text} AS text")
        return find(logs, Config.of(**config), ["event_id"]).select("event_id", *SPAN)

    return run


def resolve_scored(spark: SparkSession, sf: str) -> DataFrame:
    """A scored span beside an e-mail: shorter partial, longer partial, inside, covering, equal, apart."""
    logs = events(spark, sf).selectExpr("event_id", f"{planted.text_sql('email', 'spark')} AS text")
    at = logs.select("event_id", "text", (F.length("text") - 4).alias("e"), (F.col("event_id") % 6).alias("c"))
    spans = at.select(
        "event_id",
        F.lit(0).alias("seq"),
        F.expr("case c when 0 then 5 when 1 then 0 when 2 then 10 when 3 then 5 when 4 then 8 else 0 end").alias("start"),
        F.expr("case c when 0 then 10 when 1 then e - 1 when 2 then 14 when 3 then e + 1 when 4 then e else 4 end").alias("end"),
        "text",
        F.lit("PERSON").alias("entity"),
        F.lit(0.9).alias("confidence"),
    ).withColumn("value", F.expr("substring(text, start + 1, `end` - start)"))
    merged = scored.merge_scored(logs, spans.drop("text"), "event_id")
    return find(merged, Config(), ["event_id"], scored="scored").select("event_id", *SPAN)


def resolve_scored_odd(spark: SparkSession, sf: str) -> DataFrame:
    """Scored spans that are empty, turned round, negative or beyond the text: none is a finding."""
    logs = events(spark, sf).selectExpr("event_id", f"{planted.text_sql('email', 'spark')} AS text")
    spans = logs.select(
        "event_id",
        F.lit(0).alias("seq"),
        F.expr("case event_id % 4 when 0 then 5 when 1 then 12 when 2 then -3 else 4 end").alias("start"),
        F.expr("case event_id % 4 when 0 then 5 when 1 then 9 when 2 then 6 else 4000 end").alias("end"),
        F.lit("x").alias("value"),
        F.lit("PERSON").alias("entity"),
        F.lit(0.9).alias("confidence"),
    )
    merged = scored.merge_scored(logs, spans, "event_id")
    return find(merged, Config(), ["event_id"], scored="scored").select("event_id", *SPAN)


def first_words(batches):
    """A recogniser of another kind: takes the words before the address for a person."""
    import pandas as pd

    for batch in batches:
        at = batch["text"].str.index(" u")
        yield pd.DataFrame(
            {"event_id": batch["event_id"], "seq": 0, "start": 0, "end": at, "value": [t[:n] for t, n in zip(batch["text"], at)], "entity": "PERSON", "confidence": 0.9}
        )


def recogniser_plugged_in(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a recogniser that runs in Arrow batches, above the threshold, merged into the search."""
    logs = events(spark, sf).selectExpr("event_id", f"{planted.text_sql('email', 'spark')} AS text")
    schema = "event_id bigint, seq bigint, start int, end int, value string, entity string, confidence double"
    spans = scored.above(logs.mapInPandas(first_words, schema))
    merged = scored.merge_scored(logs, spans, "event_id")
    return find(merged, Config(), ["event_id"], scored="scored").select("event_id", *SPAN)


def preserved_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Every second customer's mail name, and a third of the orders' application folders, in capitals."""
    names = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 2 = 0").selectExpr("concat('U', c_custkey, '@') AS p")
    folders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0").selectExpr("concat('/APP', o_orderkey, '/') AS p")
    return names.union(folders)


def preserved_table(spark: SparkSession, sf: str) -> DataFrame:
    found = find(service_logs(spark, sf), Config(), ["event_id"], preserved=preserved_strings(spark, sf))
    return found.select("event_id", *SPAN)


# --- mapping, redaction, restoring --------------------------------------------------------

MAPPING = ("scope", "value", "placeholder", "prefix", "n", "first_seq", "first_pos")


def redaction(spark: SparkSession, sf: str, scope: str = "global", existing: DataFrame | None = None):
    return redact(documents(spark, sf), Config.of(REDACT_TYPES), doc="doc_id", scope=scope, existing=existing)


def log_redaction(spark: SparkSession, sf: str, scope: str):
    return redact(service_logs(spark, sf), Config(), doc="event_id", scope=scope)


def mapping_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """French documents first, then all of them on top of that mapping."""
    french = documents(spark, sf).where("lang = 'fr'")
    first = redact(french, Config.of(REDACT_TYPES), doc="doc_id").mapping
    return redaction(spark, sf, existing=first).mapping.select(*MAPPING)


def redact_document_scope(spark: SparkSession, sf: str) -> DataFrame:
    return redact_documents(documents(spark, sf), Config.of(REDACT_TYPES)).select("doc_id", "redacted")


def redact_logs_document_scope(spark: SparkSession, sf: str) -> DataFrame:
    return redact_documents(service_logs(spark, sf), Config()).select("event_id", "redacted")


def restore_documents(spark: SparkSession, sf: str) -> DataFrame:
    done = redaction(spark, sf)
    return restore(done.redacted, done.mapping, "doc_id", text="redacted").select("doc_id", "restored")


def restore_logs(spark: SparkSession, sf: str) -> DataFrame:
    done = log_redaction(spark, sf, "user_id")
    return restore(done.redacted, done.mapping, "event_id", "user_id", "redacted").select("event_id", "restored")


def restore_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that mention a known placeholder, an unknown one and a nested bracket."""
    known = log_redaction(spark, sf, "global").mapping
    answers = events(spark, sf).selectExpr(
        "event_id",
        "concat('check [IP_', lpad(cast(1 + event_id % 150 as string), 3, '0'), '] and [IP_999] or [[PATH_001]]') AS text",
    )
    return restore(answers, known, "event_id").select("event_id", "restored")


# --- audit -----------------------------------------------------------------------------------


def document_findings(spark: SparkSession, sf: str) -> DataFrame:
    return find(documents(spark, sf), Config.of(REDACT_TYPES), ["doc_id", "source", "lang"])


def preview_html(spark: SparkSession, sf: str) -> DataFrame:
    return preview(documents(spark, sf), Config.of(REDACT_TYPES)).select("doc_id", "html")


# --- custom patterns and presets -------------------------------------------------------------


def custom_config(declared: bool = False) -> Config:
    return Config.of(TOKEN_TYPES, custom=[(TOKEN, "SECRET")], custom_prefix="declared" if declared else "fixed")


def custom_token(spark: SparkSession, sf: str) -> DataFrame:
    return find(documents(spark, sf), custom_config(), ["doc_id"]).select("doc_id", *SPAN)


def custom_token_declared(spark: SparkSession, sf: str) -> DataFrame:
    return redact_documents(documents(spark, sf), custom_config(True)).select("doc_id", "redacted")


def custom_plain(spark: SparkSession, sf: str) -> DataFrame:
    config = Config.of([], custom=[("[0-9a-f]{40}", "HEX")])
    return find(documents(spark, sf), config, ["doc_id"]).select("doc_id", *SPAN)


def preset_aws(spark: SparkSession, sf: str) -> DataFrame:
    logs = events(spark, sf).selectExpr("event_id", f"{planted.fill(AWS_LINE, 'spark')} AS text")
    return find(logs, Config.of(preset="aws"), ["event_id"]).select("event_id", *SPAN)


def preset_compare(spark: SparkSession, sf: str) -> DataFrame:
    found = compare_presets(documents(spark, sf), catalog.PRESETS, ["doc_id"])
    return found.groupBy("preset", "type").agg(F.count("*").alias("n"))


# --- scored findings ---------------------------------------------------------------------------


def reported(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(
        "event_id % 1000 AS doc",
        "event_id AS seq",
        "cast(event_id % 7 as int) AS start",
        "cast(event_id % 7 + 5 as int) AS `end`",
        "upper(event_type) AS entity",
        "cast((event_id * 37) % 100 as double) / 100 AS confidence",
        "'outside' AS source",
    )


def scored_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return scored.best_per_span(reported(spark, sf), "doc")


def scored_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return scored.above(reported(spark, sf))


ENTITY = (
    "case event_id % 7 when 0 then 'person' when 1 then 'LOCATION' when 2 then 'US_PASSPORT' when 3 then 'Iban_Code' "
    "when 4 then 'password' when 5 then 'NRP' else upper(event_type) end"
)


def entity_map(spark: SparkSession, sf: str) -> DataFrame:
    named = events(spark, sf).selectExpr("event_id", f"{ENTITY} AS entity")
    return named.select("event_id", scored.type_of("entity").alias("type"))


RECOGNISE_LINE = (
    "concat('tel 06 12 34 ', lpad(cast(k % 100 as varchar(9)), 2, '0'), ' ', lpad(cast((k // 100) % 100 as varchar(9)), 2, '0'), "
    "' ssn 1850578006', lpad(cast(k % 1000 as varchar(9)), 3, '0'), '48')"
)


def recognise_french(spark: SparkSession, sf: str) -> DataFrame:
    logs = events(spark, sf).selectExpr("event_id", f"{planted.fill(RECOGNISE_LINE, 'spark')} AS text")
    found = scored.recognise(logs, "event_id")
    return found.select("event_id", "start", "end", "value", "entity", "confidence", "language")


def domain_split(spark: SparkSession, sf: str) -> DataFrame:
    split = domains.split_domains(hosts(spark, sf), suffixes(spark))
    return split.select("page_id", "host", "subdomain", "domain", "suffix", "fqdn", "is_valid", "is_private")


def domain_confidence(spark: SparkSession, sf: str) -> DataFrame:
    split = domains.split_domains(hosts(spark, sf), suffixes(spark))
    return split.select("page_id", F.round(domains.confidence(), 6).alias("confidence"), domains.entity().alias("entity"))


def domain_find(spark: SparkSession, sf: str) -> DataFrame:
    found = domains.find_domains(table(spark, sf, "pages"), suffixes(spark), "page_id", "html")
    return found.select("page_id", "start", "end", "value", "entity", F.round("confidence", 6).alias("confidence"))


def merge_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Domain findings as scored input of a full search of the same pages."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    found = domains.find_domains(pages, suffixes(spark), "page_id", "html")
    merged = scored.merge_scored(pages, found, "page_id")
    config = Config.of(["email", "ipv4", "hostname"])
    return find(merged, config, ["page_id"], "html", scored="scored").select("page_id", *SPAN)


def risk_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Users' event lines: a password for some users, an address for others, else nothing."""
    secret = planted.text_sql("api_key", "spark")
    address = planted.text_sql("ipv4", "spark")
    logs = events(spark, sf).selectExpr(
        "event_id", "user_id", f"case user_id % 3 when 0 then {secret} when 1 then {address} else 'all quiet' end AS text"
    )
    return scored.risk_scan(logs, find(logs, Config(), ["user_id"]), ["user_id"])


def risk_by_conversation(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return scored.risk_scan(turns, find(turns, Config(), ["conv_id"]), ["conv_id"])


# --- stores, SQL, streams ---------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of one mapping store; user 1 is forgotten after the first."""
    logs = service_logs(spark, sf)
    store = MappingStore(spark, scratch(spark, "store"))
    early = redact(logs.where("event_id % 2 = 0"), Config(), doc="event_id", scope="user_id")
    store.append(early.added, 0)
    store.forget(["1"], 0)
    late = redact(logs, Config(), doc="event_id", scope="user_id", existing=store.load(before=1))
    store.append(late.added, 1)
    return store.load().select("scope", "value", "placeholder")


def stored(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    return scratch(spark, "files"), redaction(spark, sf, "source").mapping


def forget_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests to forget for the same batch."""
    path, mapping = stored(spark, sf)
    store = MappingStore(spark, path, mapping.schema["first_seq"].dataType)
    store.append(mapping, 0)
    store.forget(["src0"], 0)
    store.forget(["src1"], 0)
    return store.load().select(*MAPPING)


def export_entries(spark: SparkSession, sf: str) -> DataFrame:
    path, mapping = stored(spark, sf)
    mapping_files.write_entries(mapping, path)
    return mapping_files.read_entries(spark, path).select(*MAPPING)


def import_scopes(spark: SparkSession, sf: str) -> DataFrame:
    path, mapping = stored(spark, sf)
    mapping_files.write_json(mapping, path, mapping_files.SHARD_ROWS)
    return mapping_files.import_json(spark, path)[0].select(*MAPPING[:5])


def session_mapping(spark: SparkSession, sf: str) -> DataFrame:
    path, mapping = stored(spark, sf)
    save_session(spark, Config.of(REDACT_TYPES), mapping, path)
    return load_session(spark, path, mapping.schema["first_seq"].dataType)[1].select(*MAPPING)


def redacted_written(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "redacted")
    write_redacted(redact_document_scope(spark, sf), path)
    return spark.read.parquet(path)


def sql_redact(spark: SparkSession, sf: str) -> DataFrame:
    sqlfuncs.register(spark, Config.of(REDACT_TYPES))
    documents(spark, sf).createOrReplaceTempView("inkveil_documents")
    return spark.sql("SELECT doc_id, redact_text(text) AS redacted FROM inkveil_documents")


def sql_findings(spark: SparkSession, sf: str) -> DataFrame:
    sqlfuncs.register(spark, Config.of(REDACT_TYPES))
    documents(spark, sf).createOrReplaceTempView("inkveil_documents")
    return spark.sql(
        "SELECT doc_id, f.type, f.value, f.start, f.`end` FROM "
        "(SELECT doc_id, explode(s) AS f FROM (SELECT doc_id, sensitive_findings(text) AS s FROM inkveil_documents))"
    )


def sql_table_function(spark: SparkSession, sf: str) -> DataFrame:
    sqlfuncs.register(spark, Config())
    documents(spark, sf).createOrReplaceTempView("inkveil_documents")
    types = ", ".join(f"'{t}'" for t in REDACT_TYPES)
    return spark.sql(
        f"SELECT doc_id, f.type, f.value, f.start, f.`end` FROM inkveil_documents, LATERAL findings_of(text, array({types})) AS f"
    )


def session_saved_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A session saved over another one that holds other scopes, of which some were forgotten."""
    path, mapping = stored(spark, sf)
    seq = mapping.schema["first_seq"].dataType
    save_session(spark, Config(), mapping.withColumn("scope", F.concat("scope", F.lit("-old"))), path)
    VersionedStore(spark, f"{path}/mapping", seq).forget(["src0", "src0-old"])
    save_session(spark, Config.of(REDACT_TYPES), mapping, path)
    return load_session(spark, path, seq)[1].select(*MAPPING)


def store_two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """A second writer commits the odd events while the first one numbers the even ones."""
    path = scratch(spark, "store")
    one, two = VersionedStore(spark, path), VersionedStore(spark, path)
    logs = service_logs(spark, sf)
    even, odd = (logs.where(f"event_id % 2 = {k}") for k in (0, 1))
    keyed = maps.keyed_values(spanned(even.select("event_id", "user_id", "text"), Config()), "event_id", "user_id", "event_id")
    waiting = [lambda: redact_into(odd, Config(), two, doc="event_id", scope="user_id")]

    def make(known: DataFrame, tops: DataFrame) -> DataFrame:
        if waiting:
            waiting.pop()()
        return maps.assign(keyed, known, tops)

    one.add(make, keyed.select("scope").distinct())
    return two.load().select(*MAPPING)


def uploads(spark: SparkSession, sf: str) -> str:
    """One file of log lines for every user."""
    path = scratch(spark, "uploads")
    line = planted.line_sql(planted.SERVICE_LOG, "spark")
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.col("event_id"))
    write_files(rows.selectExpr("user_id", f"{line} AS text"), path, "user_id")
    return path


def of_user(path: str):
    return F.regexp_extract(path, "user_id=([0-9]+)", 1).cast("bigint").alias("user_id")


def files_read_whole(spark: SparkSession, sf: str) -> DataFrame:
    found = find(read_documents(spark, uploads(spark, sf)), Config(), ["doc_id"])
    return found.groupBy(of_user("doc_id"), "type", "value").agg(F.count("*").alias("n"))


def files_read_by_line(spark: SparkSession, sf: str) -> DataFrame:
    found = find(read_documents(spark, uploads(spark, sf), unit="line"), Config(), ["doc_id"])
    return found.groupBy(of_user("doc_id"), "type", "value").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_lines"))


def file_in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All log lines in one file, searched by many tasks; their places count from the start of the file."""
    path = scratch(spark, "one")
    service_logs(spark, sf).orderBy("event_id").select("text").coalesce(1).write.text(path)
    return find_in_files(spark, path, Config()).select(*SPAN)


CAP = 10_000


def uploads_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the files within the cap, and the lengths of the others."""
    accepted, rejected = read_uploads(spark, uploads(spark, sf), CAP)
    found = find(accepted, Config(), ["doc_id"]).groupBy(of_user("doc_id")).agg(F.count("*").alias("n"))
    return found.withColumn("accepted", F.lit(True)).unionByName(rejected.select(of_user("doc_id"), F.col("length").alias("n"), F.lit(False).alias("accepted")))


def presets_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in presets, written as JSON files and loaded from them."""
    path = scratch(spark, "presets")
    built_in = preset_table(spark).withColumn("folder", F.col("id"))
    built_in.repartition("id").write.partitionBy("folder").json(path)
    loaded = load_presets(spark, f"{path}/folder=*")
    return compare_presets(documents(spark, sf), loaded.values(), ["doc_id"]).groupBy("preset", "type").agg(F.count("*").alias("n"))


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The service logs as a stream over the table's file."""
    at_rest = spark.read.parquet(f"{sf}/events.parquet")
    source = spark.readStream.schema(at_rest.schema).parquet(f"{sf}/events.parque*")
    line = planted.line_sql(planted.SERVICE_LOG, "spark")
    # A micro-batch takes the whole file, and a row group is one task's: rows are dealt out before they are searched.
    source = spread_stream(source, at_rest, "event_id")
    return source.selectExpr("event_id", "user_id", f"{line} AS text")


def stream_document(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "out")
    done = streams.redact_stream(log_stream(spark, sf), Config()).select("event_id", "redacted")
    writer = done.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "ck"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(path)


def stream_global(spark: SparkSession, sf: str) -> DataFrame:
    path, store = scratch(spark, "out"), VersionedStore(spark, scratch(spark, "store"))
    writer = streams.redact_stream_to(
        log_stream(spark, sf), Config(), path=path, store=store, checkpoint=scratch(spark, "ck"), doc="event_id"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "redacted")


MAX_SCOPES, SLOTS = 32, 4


def stream_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Users' scopes, of which fewer are remembered than there are."""
    return stream_keyed(spark, sf, max_scopes=MAX_SCOPES, slots=SLOTS)


def stream_keyed(spark: SparkSession, sf: str, **bounds) -> DataFrame:
    path = scratch(spark, "out")
    # One state store per shuffle partition: as many as two per core are enough here, and no more than there are slots.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(
            min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, bounds.get("slots", 1 << 31))
        ),
        "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        done = streams.redact_stream_keyed(log_stream(spark, sf), Config(), scope="user_id", seq="event_id", **bounds)
        done = done.select("event_id", "redacted")
        writer = done.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "ck"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(done.schema).parquet(path)


def stream_restore(spark: SparkSession, sf: str) -> DataFrame:
    done = log_redaction(spark, sf, "global")
    source, path = scratch(spark, "in"), scratch(spark, "out")
    done.redacted.select("event_id", "redacted").write.parquet(source)
    stream = spark.readStream.schema("event_id bigint, redacted string").parquet(source)
    stream = spread_stream(stream, spark.read.parquet(source), "event_id")
    writer = streams.restore_stream_to(
        stream, done.mapping, path=path, checkpoint=scratch(spark, "ck"), doc="event_id", text="redacted"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", "restored")


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts over two halves of the logs, with a restart between them."""
    source, out, mark, logs = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "ck"), service_logs(spark, sf)
    for step in range(2):
        logs.where(f"event_id % 2 = {step}").write.parquet(f"{source}/part{step}")
        stream = spark.readStream.schema(logs.schema).parquet(f"{source}/*")
        stream = spread_stream(stream, spark.read.parquet(f"{source}/part{step}"), "event_id")
        writer = streams.count_stream_to(stream, Config(), path=out, checkpoint=mark, keys=("user_id",))
        writer.trigger(availableNow=True).start().awaitTermination()
    return streams.counted(spark, out)


def stream_restore_growing(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams beside each other, twice: redaction adds to a store that restoring reads as it grows."""
    source, red, out, at = (scratch(spark, name) for name in ("in", "red", "out", "store"))
    marks, logs = [scratch(spark, "ck"), scratch(spark, "ck")], service_logs(spark, sf)
    for step in range(2):
        logs.where(f"event_id % 2 = {step}").write.parquet(f"{source}/part{step}")
        coming = spread_stream(spark.readStream.schema(logs.schema).parquet(f"{source}/*"), spark.read.parquet(f"{source}/part{step}"), "event_id")
        first = streams.redact_stream_to(
            coming, Config(), path=red, store=VersionedStore(spark, at), checkpoint=marks[0], doc="event_id", scope="user_id"
        )
        first.trigger(availableNow=True).start().awaitTermination()
        back = spark.readStream.schema("event_id bigint, user_id bigint, redacted string").option("recursiveFileLookup", True).parquet(red)
        back = spread_stream(back, spark.read.option("recursiveFileLookup", True).parquet(red), "event_id")
        second = streams.restore_stream_to(back, VersionedStore(spark, at), path=out, checkpoint=marks[1], doc="event_id", scope="user_id", text="redacted")
        second.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "restored")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{f"find_{kind}": find_planted(kind) for kind in planted.TEMPLATES},
        "find_all_documents": find_in("documents", "doc_id", "text"),
        "find_all_pages": find_in("pages", "page_id", "html"),
        "find_email_documents": find_in("documents", "doc_id", "text", ["email"]),
        "find_ipv4_documents": find_in("documents", "doc_id", "text", ["ipv4"]),
        "find_phone_documents": find_in("documents", "doc_id", "text", ["phone"]),
        "find_card_luhn": find_in("documents", "doc_id", "text", ["credit_card"]),
        "find_url_pages": find_in("pages", "page_id", "url", ["url"]),
        "find_hostname_pages": find_in("pages", "page_id", "html", ["hostname"]),
        "type_filter": find_in("pages", "page_id", "html", ["email", "credit_card"]),
        "preserve_filter": find_in("documents", "doc_id", "text", REDACT_TYPES, PRESERVE),
        "luhn_orders": luhn_orders,
        "phone_customers": phone_customers,
        "resolve_equal_span": overlap_case("concat('user=a', event_id, '.example.com')"),
        "resolve_later_type": overlap_case("concat('api_key=Zq', lpad(event_id, 16, '0'))"),
        "resolve_contained": overlap_case("concat('to jd', event_id, '@acme-corp.com now')"),
        "preserve_then_inner": overlap_case("concat('see https://h', event_id, '.example.com/keep')", preserve=["/keep"]),
        "resolve_scored": resolve_scored,
        "mapping_global": lambda spark, sf: redaction(spark, sf).mapping.select(*MAPPING),
        "mapping_by_source": lambda spark, sf: redaction(spark, sf, "source").mapping.select(*MAPPING),
        "mapping_incremental": mapping_incremental,
        "mapping_logs_global": lambda spark, sf: log_redaction(spark, sf, "global").mapping.select(*MAPPING),
        "mapping_logs_by_user": lambda spark, sf: log_redaction(spark, sf, "user_id").mapping.select(*MAPPING),
        "mapping_counters": lambda spark, sf: maps.counters(log_redaction(spark, sf, "user_id").mapping),
        "mapping_pairs": lambda spark, sf: maps.mapping_pairs(redaction(spark, sf).mapping).select("placeholder", "value"),
        "forget_scope": lambda spark, sf: maps.forget(redaction(spark, sf, "source").mapping, ["src0", "src1"]).select(*MAPPING),
        "redact_doc_scope": redact_document_scope,
        "redact_global": lambda spark, sf: redaction(spark, sf).redacted.select("doc_id", "redacted"),
        "redact_by_source": lambda spark, sf: redaction(spark, sf, "source").redacted.select("doc_id", "redacted"),
        "redact_logs_by_user": lambda spark, sf: log_redaction(spark, sf, "user_id").redacted.select("event_id", "redacted"),
        "redact_logs_doc_scope": redact_logs_document_scope,
        "restore_global": restore_documents,
        "restore_logs_by_user": restore_logs,
        "restore_unknown_kept": restore_answers,
        "stats_by_type": lambda spark, sf: audit.stats(document_findings(spark, sf)),
        "stats_by_source_lang": lambda spark, sf: audit.stats(document_findings(spark, sf), "source", "lang"),
        "total_replacements": lambda spark, sf: audit.total(document_findings(spark, sf), "doc_id"),
        "export_text": lambda spark, sf: mapping_files.export_text(redaction(spark, sf).mapping).select("placeholder", "line"),
        "export_json": lambda spark, sf: mapping_files.export_json(log_redaction(spark, sf, "user_id").mapping, mapping_files.SHARD_ROWS),
        "preview_html": preview_html,
        "custom_token": custom_token,
        "custom_token_declared": custom_token_declared,
        "custom_plain": custom_plain,
        "preset_aws": preset_aws,
        "preset_compare": preset_compare,
        "scored_dedup": scored_dedup,
        "scored_threshold": scored_threshold,
        "entity_map": entity_map,
        "recognise_french": recognise_french,
        "domain_split": domain_split,
        "domain_confidence": domain_confidence,
        "domain_find": domain_find,
        "merge_domains": merge_domains,
        "risk_by_user": risk_by_user,
        "risk_by_conversation": risk_by_conversation,
        "store_reset": store_reset,
        "forget_twice": forget_twice,
        "export_entries": export_entries,
        "import_scopes": import_scopes,
        "session_mapping": session_mapping,
        "redacted_written": redacted_written,
        "sql_redact": sql_redact,
        "sql_findings": sql_findings,
        "stream_document": stream_document,
        "stream_global": stream_global,
        "stream_keyed": stream_keyed,
        "stream_restore": stream_restore,
        "stream_restore_growing": stream_restore_growing,
        "stream_bounded": stream_bounded,
        "stream_counts": stream_counts,
        "resolve_scored_odd": resolve_scored_odd,
        "recogniser_plugged_in": recogniser_plugged_in,
        "preserved_table": preserved_table,
        "sql_table_function": sql_table_function,
        "session_saved_twice": session_saved_twice,
        "store_two_writers": store_two_writers,
        "files_read_whole": files_read_whole,
        "files_read_by_line": files_read_by_line,
        "uploads_capped": uploads_capped,
        "file_in_pieces": file_in_pieces,
        "presets_loaded": presets_loaded,
    }
