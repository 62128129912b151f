import pytest
from pyspark.sql import functions as F

from inkveil import Config, find
from inkveil.operators import domains, scored


@pytest.fixture
def suffixes(spark):
    from checks.queries import suffixes

    return suffixes(spark)


def test_split(spark, suffixes):
    cases = {
        "www.shop.co.uk": ("www", "shop", "co.uk", False),
        "user.github.io": ("", "user", "github.io", True),
        "a.b.foo.ck": ("a", "b", "foo.ck", False),
        "foo.ck": ("", "", "foo.ck", False),
        "www.ck": ("", "www", "ck", False),
        "x.WWW.ck": ("x", "WWW", "ck", False),
        "host.internal": ("host", "internal", "", False),
        "co.uk": ("", "", "co.uk", False),
        "com": ("", "", "com", False),
        "": ("", "", "", False),
    }
    df = spark.createDataFrame([(h,) for h in cases] + [(None,)], "host string")
    rows = {r.host: r for r in domains.split_domains(df, suffixes).collect()}
    for host, expected in cases.items():
        r = rows[host]
        assert (r.subdomain, r.domain, r.suffix, r.is_private) == expected, host
        assert r.is_valid == bool(r.domain and r.suffix)
    assert not rows[None].is_valid


def test_confidence_keeps_the_borderline(spark, suffixes):
    df = spark.createDataFrame([("a.xy.org",), ("xy.org",), ("a.xy.ck.ck",), ("abc.org",)], "host string")
    rows = {r.host: r.c for r in domains.split_domains(df, suffixes).select("host", domains.confidence().alias("c")).collect()}
    assert rows["a.xy.org"] >= 0.7
    assert rows["xy.org"] == pytest.approx(0.7)
    assert rows["abc.org"] == pytest.approx(0.9)


def test_find_domains_equals_the_score_rule(spark, docs, suffixes):
    df = docs("see shop.example.co.uk and x.nope and user.github.io, ab.org")
    rows = {r.value: r for r in domains.find_domains(df, suffixes, "doc_id").collect()}
    score = 0.5 + 0.3 + 0.1 - 0.2
    assert set(rows) == {"shop.example.co.uk", "user.github.io"} | ({"ab.org"} if score >= 0.7 else set())
    assert rows["shop.example.co.uk"].entity == "FQDN"
    assert rows["user.github.io"].metadata["is_private"] == "true"


def test_best_per_span(spark):
    rows = [(1, 0, 0, 5, "A", 0.5), (1, 1, 6, 9, "B", 0.9), (1, 2, 0, 5, "C", 0.8), (1, 3, 0, 5, "D", 0.8)]
    df = spark.createDataFrame(rows, "doc int, seq bigint, start int, end int, entity string, confidence double")
    got = sorted((r.seq, r.entity) for r in scored.best_per_span(df, "doc").collect())
    assert got == [(0, "C"), (1, "B")]


def test_entity_names(spark):
    df = spark.createDataFrame([("person",), ("US_PASSPORT",), ("whatever",)], "e string")
    assert [r[0] for r in df.select(scored.type_of("e")).collect()] == ["username", "ssn", "custom"]


def test_scored_findings_rank_first(spark, docs):
    df = docs("Jean Dupont at a.example.com", "nothing here")
    reports = spark.createDataFrame(
        [(0, 0, 0, 11, "Jean Dupont", "PERSON"), (0, 1, 15, 28, "a.example.com", "PERSON"), (0, 2, 3, 3, "", "PERSON"), (0, 3, -1, 4, "x", "PERSON")],
        "doc_id int, seq bigint, start int, end int, value string, entity string",
    )
    merged = scored.merge_scored(df, reports, "doc_id")
    got = sorted((r.type, r.value) for r in find(merged, Config(), ["doc_id"], scored="scored").collect())
    assert got == [("hostname", "a.example.com"), ("username", "Jean Dupont")]
    fewer = Config().set_pattern_enabled("username", False).set_pattern_enabled("hostname", False)
    assert find(merged, fewer, ["doc_id"], scored="scored").count() == 0
    preserved = Config.of(preserve=["dupont"])
    assert [r.value for r in find(merged, preserved, ["doc_id"], scored="scored").collect()] == ["a.example.com"]


def test_recognisers_follow_languages_and_threshold(docs):
    df = docs("tel 06 12 34 56 78 ssn 185057800608448 at shop.example.com")
    french = {(r.entity, r.value) for r in scored.recognise(df, "doc_id").collect()}
    assert ("PHONE_NUMBER", "06 12 34 56 78") in french and ("FR_SSN", "185057800608448") in french
    assert scored.recognise(df, "doc_id", languages=["en"]).count() == 0
    low = scored.recognise(df, "doc_id", languages=["en"], threshold=0.6).collect()
    assert [r.value for r in low] == ["shop.example.com"]


def test_risk(docs):
    df = docs("api_key=Zqxw0123456789abcdef", "10.0.0.1", "calm")
    rows = {r.doc_id: r for r in scored.risk_scan(df, find(df, Config(), ["doc_id"]), ["doc_id"]).collect()}
    assert (rows[0].secrets_safe, rows[0].pii_safe, rows[0].risk_score) == (False, True, 1.0)
    assert (rows[1].secrets_safe, rows[1].pii_safe, rows[1].is_safe) == (True, False, False)
    assert rows[2].is_safe and rows[2].risk_score == 0.0


def test_outside_recogniser_as_a_function_of_batches(spark, docs):
    """The extension point: any function over Arrow batches that reports spans."""

    def shouting(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                at = text.find("SECRET")
                if at >= 0:
                    out.append((doc, 0, at, at + 6, "SECRET", "SECRET"))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "start", "end", "value", "entity"])

    df = docs("the SECRET word", "plain")
    reports = df.mapInPandas(shouting, "doc_id int, seq bigint, start int, end int, value string, entity string")
    merged = scored.merge_scored(df, reports, "doc_id")
    assert [(r.type, r.value) for r in find(merged, Config(), ["doc_id"], scored="scored").collect()] == [("api_key", "SECRET")]
