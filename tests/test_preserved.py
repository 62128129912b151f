import random

from inkveil import Config, find, redact
from inkveil.operators.preserved import anchors, holding


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def held(spark, values, preserved):
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    return sorted(r.value for r in holding(rows, strings(spark, *preserved)).collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    make = lambda low, high: "".join(r.choice("abAB.\n") for _ in range(r.randint(low, high)))
    values = list({make(0, 40) for _ in range(300)} | {make(4000, 9000) for _ in range(3)})
    preserved = [make(1, 9) for _ in range(60)] + [make(30, 70) for _ in range(10)] + [values[0][3:9] or "a", values[-1][4090:4160]]
    preserved = [p for p in preserved if len(p) > 5] + ["b.b", None]
    want = sorted(v for v in values if any(p.lower() in v.lower() for p in preserved if p is not None))
    assert held(spark, values, preserved) == want and 0 < len(want) < len(values)


def test_odd_cases(spark):
    assert held(spark, ["a", "b", None, ""], []) == [] and held(spark, ["a", "b"], [None]) == []
    assert held(spark, ["a", "b", ""], [""]) == ["", "a", "b"]
    assert held(spark, ["xÉ😀z"], ["é😀"]) == ["xÉ😀z"]


def test_anchors_are_the_rarest_pieces(spark):
    same = "https://www.example.com/a/long/path/to/"
    got = anchors(strings(spark, *(f"{same}{i:04}" for i in range(200)), "ab"), "text").collect()
    pieces = [r.piece for r in got if len(r.p) > 2]
    assert len(got) == 201 and len(set(pieces)) == 200 and all(len(p) == 32 for p in pieces)


def test_as_the_listed_ones(spark, docs):
    table = docs("see https://h1.example.com/keep and 10.0.0.1", "mail a@x.com, b@x.com", None, "none", "KEEP@x.com keep.example.com")
    listed, config = Config.of(preserve=["/keep", "B@", "Keep@"]), Config()
    more = strings(table.sparkSession, "/keep", "B@", "Keep@", "b@")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(find(table, config, ["doc_id"], preserved=more)) == rows(find(table, listed, ["doc_id"]))
    one, two = redact(table, config, doc="doc_id", preserved=more), redact(table, listed, doc="doc_id")
    assert rows(one.redacted) == rows(two.redacted) and rows(one.mapping) == rows(two.mapping)
