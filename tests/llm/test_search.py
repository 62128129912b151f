"""Decontamination, SimHash and line dedup against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkveil.llm import lines, postings, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, positions string, __bad string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "p", "b") for i, t, s in rows], DOCS)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(seed, n=40, vocabulary=60):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, vocabulary, n))


# --- decontamination


def hits(text, tests):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, items = re.findall(word, ascii_lower(text)), set(), set()
    for item, test in tests:
        t = re.findall(word, ascii_lower(test))
        n = min(13, len(t))
        for k in range(len(t) - n + 1 if t else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == t[k : k + n]:
                    hit |= set(range(i, i + n))
                    items.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words)


TESTS = [(1, sentence(1)), (2, sentence(2, 20)), (10, "short Item, three"), (2, sentence(3, 13)), (None, sentence(4, 15)), (5, None), (6, " .,- ")]


def contaminated_rows():
    one, two = sentence(1), sentence(2, 20)
    rows = [(0, None, "a"), (1, "", "a"), (2, one, "a"), (3, "x y " * 400 + one[:60], "b"), (4, "ab " * 20 + one.upper() + "!" + two, "b")]
    rows += [(5, "A SHORT-item three b " * 3, "c"), (5, "again short item three", "c"), (None, sentence(4, 15), "c"), (7, "é" + one + "é", None)]
    rows += [(8, " ".join(one.split()[:13] * 2000), "d"), (9, one.replace(" ", "."), "e"), (10, "w1 " * 30, "e")]
    return rows


def test_contamination_equals_brute_force(spark, monkeypatch):
    rows = contaminated_rows()
    tests = spark.createDataFrame(TESTS, "item_id bigint, text string")
    expected = sorted(repr((i, *hits(t, TESTS))) for i, t, _ in rows)

    def found():
        out = postings.contamination(docs_of(spark, rows), tests).drop("n_near").collect()
        return sorted(repr(tuple(r)) for r in out)

    assert found() == expected
    # Small segments and blocks: the same rows.
    monkeypatch.setattr(postings, "BLOCK_BYTES", 100)
    monkeypatch.setattr(postings, "CANDIDATES", 3)
    assert found() == expected


def test_loose_matches_and_empty_tables(spark):
    words = sentence(1, 13, 500).split()
    moved = [*words[:5], "extra", *words[5:]]
    tests = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    row = postings.contamination(docs_of(spark, [(1, " ".join(moved), "a"), (2, " ".join(words), "a"), (3, words[0], "a")]), tests).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_near) for r in row] == [(0, 1), (13, 0), (0, 0)]
    # A window with many owners fills several blocks and counts once.
    owners = spark.createDataFrame([(i, " ".join(words)) for i in range(40)], "item_id bigint, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(postings, "BLOCK_BYTES", 300)
        assert postings.blocks(owners, "item_id", "text").count() > 2
        many = postings.contamination(docs_of(spark, [(1, " ".join(moved), "a"), (2, " ".join(words), "a")]), owners).orderBy("doc_id").collect()
        assert [(r.n_hit, r.n_near, r.n_items) for r in many] == [(0, 1, 0), (13, 0, 40)]
    none = tests.where("false")
    assert postings.contamination(docs_of(spark, [(1, "a b", "a")]), none).first().n_items == 0
    assert postings.contamination(docs_of(spark, []), tests).count() == 0


def test_small_blocks_are_looked_up_together(spark, monkeypatch):
    """As many parts as the cluster likes make as many small blocks, but the index is read once for them all."""
    rows = contaminated_rows()
    tests = spark.createDataFrame([*TESTS, (7, sentence(3, 30, 500))], "item_id bigint, text string")
    expected = sorted(repr((i, *hits(t, [*TESTS, (7, sentence(3, 30, 500))]))) for i, t, _ in rows)
    dealt = type(tests).repartitionByRange
    monkeypatch.setattr(type(tests), "repartitionByRange", lambda df, n, *by: dealt(df, 40, *by))
    assert postings.blocks(tests, "item_id", "text").count() > 10
    reads, run = [], postings._look_up
    monkeypatch.setattr(postings, "_look_up", lambda block: reads.append(len(block.owners)) or run(block))
    out = postings.contamination(docs_of(spark, rows), tests).drop("n_near").collect()
    assert sorted(repr(tuple(r)) for r in out) == expected and len(reads) == 1


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, tests = docs_of(spark, contaminated_rows()), spark.createDataFrame(TESTS, "item_id bigint, text string")
    kept = postings.clean(docs, tests)
    assert kept.columns == docs.columns
    expected = sorted(repr((i, t)) for i, t, _ in contaminated_rows() if not hits(t, TESTS)[4])
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == expected


# --- SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", "one", "Two WORDS", "É é É\x85x y z", sentence(3, 300), "a b\x0bc\x0c\x1cd " * 50):
        assert simhash.fingerprint(text) == fingerprint(text)


def test_blocks_of_long_texts(monkeypatch):
    expected = fingerprint(sentence(5, 500))
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(sentence(5, 500)) == expected


def brute_components(prints):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {p: top(p) for p in prints}


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def test_links_of_random_and_crowded_fingerprints(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 40, dtype=np.uint64)]
    prints = set(base)
    for b in base[:15]:  # chains of one to three changed bits
        for _ in range(6):
            b ^= sum(1 << int(k) for k in set(r.integers(0, 64, int(r.integers(1, 4)))))
            prints.add(b)
    for hub in base[20:22]:  # crowded: the same high or low half
        prints |= {hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 32, (60, 2))}
        prints |= {hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(32, 64, (60, 2))}
        prints |= {hub ^ (1 << int(a)) for a in range(64)}
    expected = brute_components(sorted(prints))
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    for bucket in (4, 10_000):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {row.node: row.root for row in simhash.components(simhash.links(table)).collect()}
        sets, wanted = defaultdict(set), defaultdict(set)
        for p in prints:
            sets[got.get(signed(p), signed(p))].add(p)
            wanted[expected[p]].add(p)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, wanted.values()))


def test_groups_and_one_of_each(spark):
    long = sentence(7, 200)
    rows = [(9, long, "a"), (4, long + " w1", "a"), (6, long, "b"), (2, sentence(8, 50), "a"), (3, None, "a"), (1, "", None), (None, sentence(9, 50), "c")]
    rows += [(2, sentence(8, 50), "a"), (None, long, "x")]
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = {i: fingerprint(t) for i, t, _ in rows if i is not None}
    groups = brute_components(sorted(set(prints.values()) | {fingerprint(sentence(9, 50))}))
    least = defaultdict(list)
    for i, t, _ in rows:
        least[groups[fingerprint(t)]].append(i)
    expected = [(i, f"{fingerprint(t):016x}", min((x for x in least[groups[fingerprint(t)]] if x is not None), default=None)) for i, t, _ in rows]
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))
    kept = simhash.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert kept.count() == len({groups[fingerprint(t)] for _, t, _ in rows})
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


# --- lines


def test_lines_equal_brute_force(spark):
    wide, edge, narrow = "a line that is on very many sites", "a line  that is on\tjust ten sites", "a line that is on only nine sites"
    rows = [(i, "\n".join([f"own line of document {i}", wide if i < 30 else "x", edge if i % 20 < 10 else "", narrow if i % 20 < 9 else "", "short"]), f"s{i % 20}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (None, wide + "\n" + wide, None), (102, f" {wide} ", "s3"), (102, "kept line of some length\n\n", "s3")]
    fold = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[fold(line)].add(site)
    out = {line for line, s in sites.items() if len(line) >= lines.MIN_CHARS and len(s - {None}) >= lines.SITES}
    assert out == {fold(wide), fold(edge)}
    docs = docs_of(spark, rows)
    got = lines.cleaned(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "n_removed"])
    expected = [(i, None if t is None else "\n".join(x for x in t.split("\n") if fold(x) not in out)) for i, t, _ in rows]
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, expected))
    assert lines.cleaned(docs_of(spark, [])).count() == 0


def test_near_threshold_lines_are_counted(spark):
    rows = [(i, f"this line stands on site after site\nanother one is on fewer of them {i < 99}", f"site{i}") for i in range(100)]
    occurrences = lines.occurrences(docs_of(spark, rows))
    found = {r.h for r in lines.boilerplate(occurrences, 100).collect()}
    counts = {r.h: r.n for r in occurrences.groupBy("h").agg(F.countDistinct("site").alias("n")).collect()}
    assert found == {h for h, n in counts.items() if n >= 100} and len(found) == 1
