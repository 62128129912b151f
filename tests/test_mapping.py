import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil import Config, redact, redact_documents, restore
from inkveil.operators import mapping as maps, rewrite
from inkveil.operators.restore import TOKEN, expand_nested, with_tokens
from tests.test_detectors import random_texts


def texts(result):
    return [r.redacted for r in result.redacted.orderBy("doc_id").collect()]


def test_numbering_runs_backwards_within_a_document(docs):
    df = docs("a@x.com b@x.com", "a@x.com b@x.com a@x.com", "A@x.com a@x.com")
    got = [r.redacted for r in redact_documents(df, Config()).orderBy("doc_id").collect()]
    assert got == [
        "[EMAIL_002] [EMAIL_001]",
        "[EMAIL_001] [EMAIL_002] [EMAIL_001]",
        "[EMAIL_002] [EMAIL_001]",
    ]


def test_both_paths_share_a_counter_and_brackets_stay(docs):
    df = docs("C:\\a\\b and /var/log/x", "ok: [SRV-1]")
    got = [r.redacted for r in redact_documents(df, Config()).orderBy("doc_id").collect()]
    assert got == ["[PATH_002] and [PATH_001]", "ok: [[SERVER_001]]"]


def test_value_keeps_the_prefix_of_its_last_occurrence(docs):
    df = docs("user=a.example.com x a.example.com", "a.example.com x user=a.example.com")
    got = [r.redacted for r in redact_documents(df, Config()).orderBy("doc_id").collect()]
    assert got == ["user=[HOST_001] x [HOST_001]", "[USER_001] x user=[USER_001]"]


def test_global_scope_goes_on_over_documents(docs):
    result = redact(docs("a@x.com b@x.com", "c@x.com a@x.com", None, "none"), Config(), doc="doc_id")
    assert texts(result) == ["[EMAIL_002] [EMAIL_001]", "[EMAIL_003] [EMAIL_002]", None, "none"]


def test_placeholders_widen_past_999(docs):
    line = " ".join(f"u{i}@x.com" for i in range(1001))
    row = redact_documents(docs(line), Config.of(["email"])).first()
    assert row.redacted.startswith("[EMAIL_1001] [EMAIL_1000] [EMAIL_999]")


def test_one_document_equals_the_rule_stated_in_python(docs):
    from inkveil.plans.pipelines import spanned

    rows = redact_documents(spanned(docs(*random_texts(5, 300)), Config()).withColumnRenamed("spans", "found"), Config()).collect()
    for row in rows:
        known, top, text = {}, {}, row.text
        for s in reversed(row.found):
            if s.value not in known:
                top[s.prefix] = top.get(s.prefix, 0) + 1
                known[s.value] = f"[{s.prefix}_{top[s.prefix]:03d}]"
            text = text[: s.start] + known[s.value] + text[s.end :]
        assert row.redacted == text
        assert {m.value: m.placeholder for m in row.mapping} == known


@pytest.fixture
def corpus(docs):
    lines = [f"mail u{i % 7}@x.com from 10.0.0.{i % 5} open /var/log/a{i}.log user=bob{i % 3}x" for i in range(200)]
    return docs(*lines).withColumn("team", (F.col("doc_id") % 3).cast("string"))


@pytest.mark.parametrize("scope", ["global", "team"])
def test_two_batches_equal_one(corpus, scope):
    whole = redact(corpus, Config(), doc="doc_id", scope=scope)
    first = redact(corpus.where("doc_id < 90"), Config(), doc="doc_id", scope=scope)
    second = redact(corpus.where("doc_id >= 90"), Config(), doc="doc_id", scope=scope, existing=first.mapping)
    both = first.redacted.unionByName(second.redacted)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.redacted.collect()))
    assert sorted(map(tuple, second.mapping.collect())) == sorted(map(tuple, whole.mapping.collect()))


@pytest.mark.parametrize("scope", ["global", "team"])
def test_numbers_are_dense_and_unique(corpus, scope):
    m = redact(corpus, Config(), doc="doc_id", scope=scope).mapping
    bad = m.groupBy("scope", "prefix").agg(F.count("*").alias("c"), F.max("n").alias("top"), F.countDistinct("n").alias("d"))
    assert bad.where("c <> top or c <> d").count() == 0
    assert m.groupBy("scope", "value").count().where("count > 1").count() == 0


def test_result_does_not_depend_on_partitions(corpus):
    expected = texts(redact(corpus.coalesce(1), Config(), doc="doc_id"))
    assert texts(redact(corpus.repartition(13), Config(), doc="doc_id")) == expected


@pytest.mark.parametrize("share", [10, 10**9])
@pytest.mark.parametrize("hot_fits", [True, False])
def test_hot_and_cold_keys_take_different_joins_to_the_same_result(corpus, monkeypatch, share, hot_fits):
    expected = texts(redact(corpus, Config(), doc="doc_id", scope="team"))
    monkeypatch.setattr(rewrite, "fits_broadcast", lambda table: hot_fits and "__hot" in table.columns)
    monkeypatch.setattr(rewrite, "HOT_SHARE", share)
    result = redact(corpus, Config(), doc="doc_id", scope="team")
    assert texts(result) == expected
    back = restore(result.redacted, result.mapping, "doc_id", "team", "redacted")
    assert back.where("restored <> text").count() == 0


def test_shared_document_ids_fail(docs):
    df = docs("a@x.com", "b@x.com").withColumn("doc_id", F.lit(1))
    with pytest.raises(Exception, match="not unique"):
        redact(df, Config(), doc="doc_id").redacted.collect()


def test_missing_scopes_are_redacted_and_missing_ids_fail(spark):
    df = spark.createDataFrame([(0, None, "a@x.com"), (1, "s", "b@x.com")], "doc_id int, team string, text string")
    result = redact(df, Config(), doc="doc_id", scope="team")
    assert texts(result) == ["[EMAIL_001]", "[EMAIL_001]"]
    back = restore(result.redacted, result.mapping, "doc_id", "team", "redacted")
    assert back.where("restored <> text").count() == 0
    bad = spark.createDataFrame([(None, "a@x.com")], "doc_id int, text string")
    with pytest.raises(Exception, match="id is null"):
        redact(bad, Config(), doc="doc_id")


def test_round_trip(docs):
    df = docs(*random_texts(21, 300)).where("not rlike(text, '\\\\[[^\\\\[\\\\]]+_[0-9]{3,}\\\\]')")
    result = redact(df, Config(), doc="doc_id")
    back = restore(result.redacted, result.mapping, "doc_id", text="redacted")
    assert back.where("not (restored <=> text)").count() == 0
    assert back.count() == df.count()


def test_tokens_of_short_texts_are_found_in_batches(docs):
    """Placeholders in short ASCII texts are found by Arrow, with the positions of Python's pattern; others pass by."""
    pick = random.Random(3)
    parts = "[IP_001]|[|]|_|001|[A B_1234]|[[X_001]]|[X_01]|[_001]|\n|[a\nb_007]|x|[IP_001_002]|_999]|[é_001]|\x00".split("|")
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 9))) for _ in range(1500)] + [None, "x" * 40_000 + "[IP_001]"]
    found = with_tokens(docs(*texts))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        assert [(t.start, t.end) for t in row.tokens] == [m.span() for m in re.finditer(TOKEN, row.text or "")]


def test_restore_leaves_unknown_tokens(docs, spark):
    known = spark.createDataFrame([("", "10.0.0.1", "[IP_001]", "IP", 1, 0, 0)], maps.empty_mapping(spark).schema)
    back = restore(docs("[IP_001] [IP_999] [[IP_001]] [ip_001] [IP_0010]"), known, "doc_id")
    assert back.first().restored == "10.0.0.1 [IP_999] [10.0.0.1] [ip_001] [IP_0010]"


def test_slices_of_long_texts(docs):
    text = "".join(f"{'x' * (i % 5000)} u{i}@x.com" for i in range(0, 60_000, 1777))
    result = redact_documents(docs(text), Config.of(["email"])).first()
    expected = text
    for m in result.mapping:
        expected = expected.replace(m.value, m.placeholder)
    assert result.redacted == expected


def test_searching_happens_once(corpus):
    """The regexes must not be inlined into several consumers."""
    from inkveil import find

    plan = find(corpus, Config.of(["email"]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert "ReadSchema" not in plan


def test_nested_placeholders_follow_the_order_of_entries(spark, docs):
    rows = [
        ("", "one [IP_002] and [VAL_009]", "[VAL_001]", "VAL", 1, 0, 0),
        ("", "two [IP_003] [VAL_001]", "[IP_002]", "IP", 2, 1, 0),
        ("", "three", "[IP_003]", "IP", 3, 2, 0),
    ]
    known = spark.createDataFrame(rows, maps.empty_mapping(spark).schema)
    text = "[VAL_001] / [IP_002]"
    expected = text
    for _, value, placeholder, *_ in rows:
        expected = expected.replace(placeholder, value)
    assert restore(docs(text), expand_nested(known), "doc_id").first().restored == expected
    plain = known.where("n = 3")
    assert expand_nested(plain).collect() == plain.collect()


def test_values_are_grouped_alike_whether_they_repeat_or_not(spark):
    from inkveil.operators.numbering import values_of
    from inkveil.operators.resolve import SPANS

    once = [(0, 2, "t", "P", "b"), (3, 5, "t", "Q", "a")]
    again = [*once, (6, 8, "t", "R", "b")]
    df = spark.createDataFrame([(0, once), (1, again), (2, [])], f"id int, spans {SPANS}")
    rows = {r.id: [(v.value, v.last, v.prefix, [tuple(s) for s in v.at]) for v in r.v] for r in df.select("id", values_of().alias("v")).collect()}
    assert rows == {0: [("a", 3, "Q", [(3, 5)]), ("b", 0, "P", [(0, 2)])], 1: [("a", 3, "Q", [(3, 5)]), ("b", 6, "R", [(0, 2), (6, 8)])], 2: []}


def test_a_mapping_alone_plans_no_texts(docs, monkeypatch):
    from inkveil.plans import pipelines

    asked = []
    lookup = pipelines.edits_by_lookup
    monkeypatch.setattr(pipelines, "edits_by_lookup", lambda *a, **k: asked.append(1) or lookup(*a, **k))
    done = redact(docs("a@x.com and b@x.com", "a@x.com"), Config(), doc="doc_id")
    assert done.mapping.count() == 2 and not asked
    assert {r.redacted for r in done.redacted.collect()} == {"[EMAIL_002] and [EMAIL_001]", "[EMAIL_002]"}
    assert done.redacted is done.redacted and len(asked) == 1
