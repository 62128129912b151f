import random

from pyspark.sql import functions as F

from inkveil.operators.candidates import CANDIDATES
from inkveil.operators.resolve import resolve


def settled(candidates):
    """The rules in plain words: a newcomer is refused, or replaces what it overlaps."""
    kept = []
    for x in candidates:
        hit = [e for e in kept if x["end"] > e["start"] and x["start"] < e["end"]]
        covered = [e for e in hit if x["start"] <= e["start"] and x["end"] >= e["end"]]
        rest = [e for e in hit if e not in covered]
        if any(e["start"] <= x["start"] and e["end"] >= x["end"] for e in rest):
            continue
        if any(x["end"] - x["start"] <= e["end"] - e["start"] for e in rest):
            continue
        kept = [e for e in kept if e not in hit] + [x]
    return sorted((e["start"], e["end"], e["value"]) for e in kept)


def test_random_candidates(spark):
    rng = random.Random(7)
    lists = []
    for _ in range(600):
        wide = rng.choice([20, 60, 400])
        items = []
        for i in range(rng.randint(0, 25)):
            start = rng.randint(0, wide)
            items.append((rng.randint(0, 6), i, start, start + rng.randint(1, 12), "t", "P", f"v{i}"))
        items.sort()
        lists.append(items)
    df = spark.createDataFrame(list(enumerate(lists)), f"id int, candidates {CANDIDATES}")
    got = {r.id: r.spans for r in df.select("id", resolve("candidates").alias("spans")).collect()}
    for i, items in enumerate(lists):
        plain = [dict(start=c[2], end=c[3], value=c[6]) for c in items]
        assert [(s.start, s.end, s.value) for s in got[i]] == settled(plain)


def test_spans_are_disjoint_and_ordered(docs):
    from inkveil import Config
    from inkveil.plans.pipelines import spanned
    from tests.test_detectors import random_texts

    for row in spanned(docs(*random_texts(11, 400)), Config()).select("spans").collect():
        for a, b in zip(row.spans, row.spans[1:]):
            assert a.end <= b.start


def test_later_rank_wins_on_equal_spans(spark):
    df = spark.createDataFrame(
        [([(1, 0, 0, 5, "a", "A", "x"), (2, 0, 0, 5, "b", "B", "x")],)], f"candidates {CANDIDATES}"
    )
    assert df.select(F.explode(resolve("candidates")).alias("s")).select("s.type").collect()[0][0] == "b"


def test_few_and_many_candidates_follow_the_same_rules(spark, monkeypatch):
    from inkveil.operators import resolve as module

    rng = random.Random(9)
    lists = [
        sorted((rng.randint(0, 6), i, at := rng.randint(0, 50), at + rng.randint(1, 12), "t", "P", f"v{i}") for i in range(rng.randint(0, 20)))
        for _ in range(200)
    ]
    df = spark.createDataFrame(list(enumerate(lists)), f"id int, candidates {CANDIDATES}")

    def settled_up_to(few):
        monkeypatch.setattr(module, "FEW", few)
        return df.select("id", resolve("candidates").alias("spans")).orderBy("id").collect()

    assert settled_up_to(0) == settled_up_to(8) == settled_up_to(20)
