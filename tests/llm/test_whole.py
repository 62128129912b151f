"""Whole results where there are many groups, few rows of a kind, copies, or long names."""

from collections import Counter

import numpy as np

from inkveil.llm import language, mixing, personal, simhash, wrappers
from tests.llm.test_models import brute_positions, docs_of, plain, prose

# --- mixing


def brute_weights(rows):
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode())
    roots = sum(np.sqrt(n) for n in size.values())
    return {s: max(1, int(np.floor(mixing.PERIOD * np.sqrt(n) / max(roots, 1) + 0.5))) for s, n in size.items()}


def test_every_source_is_scheduled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    r = np.random.default_rng(4)
    rows = [(i, "x" * int(r.integers(1, 90)), "en", f"s{i % 700}" if i % 900 else None) for i in range(1500)]
    rows += [(5000 + i, "y" * 80, "en", f"s{int(r.integers(0, 12)) * 61}") for i in range(2500)]
    weights = brute_weights(rows)
    assert len(weights) > 600 and sum(w > 1 for w in weights.values()) > 5 and sum(w == 1 for w in weights.values()) > 400
    assert plain(mixing.positions(docs_of(spark, rows)).collect()) == sorted(map(repr, brute_positions(rows, weights)))


def test_given_weights_hold_for_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    r = np.random.default_rng(9)
    rows = [(i, "x" * (1 + i % 50), "en", f"s{i % 450}") for i in range(900)]
    weights = {f"s{int(i)}": int(w) for i, w in zip(r.permutation(450)[:40], r.integers(2, 12, 40), strict=True)}
    assert plain(mixing.positions(docs_of(spark, rows), weights).collect()) == sorted(map(repr, brute_positions(rows, weights)))


# --- components


def test_components_of_a_chain_with_two_roots_in_a_round(spark):
    chain = spark.createDataFrame([(1, 3), (3, 4), (4, 5), (2, 5)], "a bigint, b bigint")
    got = sorted(tuple(r) for r in simhash.components(chain).collect())
    assert got == [(n, 1) for n in range(1, 6)]


def test_components_of_random_chains(spark):
    r = np.random.default_rng(2)
    edges, want = [], []
    for k in range(60):
        nodes = [100 * k + int(x) for x in r.permutation(5 + k % 4)]
        edges += [(min(p), max(p)) for p in zip(nodes, nodes[1:])]
        want += [(n, 100 * k) for n in nodes]
    got = sorted(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == sorted(want)


# --- personal data


def test_rare_kinds_are_calibrated_beside_many_loose_proposals(spark, monkeypatch):
    monkeypatch.setattr(personal, "SAMPLE", 200)
    names = [f for f in personal.FEATURES if f != "kind"]
    good, bad = [1.0] * len(names), [0.0 if f == "valid" else 1.0 for f in names]
    rows = [(i, 3, 5, 21, True, False, *good) for i in range(2000)] + [(i, 3, 40, 56, False, True, *bad) for i in range(6000)]
    rows += [(i, 0, 70, 80, True, False, *good) for i in range(3)] + [(9, 0, 90, 99, False, True, *good), (9, 0, 190, 199, False, True, *bad)]
    schema = "row bigint, kind int, start int, end int, base boolean, free boolean, " + ", ".join(f"{f} double" for f in names)
    assert [tuple(r) for r in personal.added(spark.createDataFrame(rows, schema)).collect()] == [(9, 0, 90, 99)]


# --- pages


def texts_of(spark, pages):
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in wrappers.main_texts(table).collect()}


def test_texts_of_some_pages_are_no_boilerplate(spark):
    own = lambda i: f"<div><p>first {i}</p>{'<h2>Summary</h2>' if i % 2 else ''}<p>more {i}</p></div><address>The house</address>"
    got = texts_of(spark, [(i, "http://a.example/", own(i)) for i in range(12)])
    assert all(got[i] == f"first {i}\n" + "Summary\n" * (i % 2) + f"more {i}" for i in range(12))


def test_copies_are_no_evidence_of_a_template(spark):
    copy = "<h1>News</h1><div><p>The only paragraph.</p></div>"
    got = texts_of(spark, [(i, "http://a.example/", copy) for i in range(5)] + [(9, "http://a.example/", copy.replace("only", "other"))])
    assert all(got[i] == "News\nThe only paragraph." for i in range(5)) and got[9] == "News\nThe other paragraph."


def test_names_after_long_class_lists_count(spark):
    utilities = " ".join(f"md-gap-{w} text-{w}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) + " overflow-hidden"
    assert len(utilities) > 100
    own = lambda i: (
        f"<div class='{utilities}' role=navigation><p>menu {i}</p></div><div class='{utilities}' id=pageSidebar><p>side {i}</p></div>"
        f"<div class='{utilities}' itemprop=articleBody><p>text {i}</p></div><div class='{utilities}'><p>beside {i}</p></div>"
    )
    got = texts_of(spark, [(i, "http://a.example/", own(i)) for i in range(4)])
    assert got == {i: f"text {i}" for i in range(4)}


# --- language


def test_all_labels_are_learned(spark):
    rows = [(2 * k + j, " ".join(chr(0x4E00 + 5 * k + x) * 3 for x in (0, 1, 2, 3 + j)), f"l{k:03}", "s") for k in range(132) for j in range(2)]
    model = language.fit(docs_of(spark, rows))
    assert sorted(lang for group in model.members for lang in group) == [f"l{k:03}" for k in range(132)]
    said = {r.doc_id: r.lang_pred for r in language.predict(docs_of(spark, rows), model, ["doc_id"]).collect()}
    assert sum(said[i] == lang for i, _, lang, _ in rows) >= 260


def test_copies_leave_no_label_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 4)
    seen = []
    monkeypatch.setattr(language.Model, "fit", staticmethod(lambda x, langs: seen.extend(langs)))
    rows = [(i, prose("en", i), "en", "s") for i in range(300)]
    rows += [(1000 + 400 * k + i, f"{prose('de', k)} {i % 2}", f"x{k}", "s") for k in range(5) for i in range(400)]
    language.fit(docs_of(spark, rows))
    assert Counter(seen) == {"en": 4} | {f"x{k}": 2 for k in range(5)}
