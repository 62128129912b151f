"""Classifiers, rules, personal data, mixing, token files, pages and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inkveil.llm import cotraining, language, mixing, personal, rules, simhash, token_files, wrappers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string, c0 string, score double"
WORDS = {
    "en": "the of and that with from which would other there their about water little house people",
    "de": "der die und nicht mit sich auch werden haben einer wasser kleine haus leute zwischen über",
    "fr": "le les des une dans pour avec être cette aussi leur eau petite maison gens où après",
    "es": "el los las una para con como pero este también agua pequeña casa gente donde después",
}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "r", "c", 0.5) for i, t, lang, s in rows], DOCS)


def prose(lang, seed, n=30):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS[lang].split(), n))


def corpus(n=160):
    langs = sorted(WORDS)
    return [(i, prose(langs[i % 4], i, 20 + i % 30), langs[i % 4], f"s{i % 3}") for i in range(n)]


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


# --- language


def test_language(spark):
    rows = [*corpus(), (500, None, "en", "a"), (501, "", "en", "a"), (502, "123 ### !", "de", None), (None, prose("fr", 900), None, "a"), (3, prose("en", 901) * 400, "en", "a")]
    found = language.identify(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    said = {r.doc_id: r for r in found if r.doc_id not in (None, 3)}
    truth = {i: lang for i, _, lang, _ in rows}
    assert all(said[i].lang_pred == truth[i] for i in range(160) if i in said)
    assert [said[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in said.items())
    assert [r.lang_pred for r in found if r.doc_id is None] == ["fr"]
    kept = language.accepted(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == len(rows) - 3


def test_language_without_labels_or_rows(spark):
    unlabelled = docs_of(spark, [(1, "some words", None, "a"), (2, "...", None, "a")])
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert [r.doc_id for r in language.accepted(unlabelled).collect()] == [1]
    assert language.identify(docs_of(spark, [])).count() == 0
    one = docs_of(spark, [(i, "some words", "xx", "a") for i in range(8)])
    assert {r.lang_pred for r in language.identify(one).collect()} == {"xx"}


# --- quality classifier


def test_cotraining(spark):
    r = np.random.default_rng(3)
    good = lambda i: i % 3 != 0
    text = lambda i: prose("en", i) if good(i) else " ".join(r.choice(["###", "$$", "|", "%%%"], 30))
    rows = [(i, text(i), "en", "clean" if good(i) else f"s{i % 2}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(good(i)), 0) for i in range(150)] + [(1, 1, 0), (9999, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    found = {x.doc_id: x for x in cotraining.scored(docs_of(spark, [*rows, (1000, None, None, None)]), labels).collect()}
    assert len(found) == 401
    assert sum(found[i].kept == good(i) for i in range(400)) >= 396
    assert all(0 <= x.score <= 1 and 0 <= x.meta_score <= 1 for x in found.values())


def test_cotraining_hands_labels_to_the_other_view():
    # The text view knows two words from the labels; metadata teach it the others.
    r = np.random.default_rng(5)
    y = np.array([1, 0] * 200)
    said = np.where(np.arange(400) < 24, y, -1)
    meta = np.eye(cotraining.META, dtype=np.float32)[y]
    text = np.zeros((400, cotraining.BUCKETS), dtype=np.float32)
    text[np.arange(400), np.where(np.arange(400) < 24, y, 2 + y * 20 + r.integers(0, 20, 400))] = 1
    held = np.arange(400) % 4 >= 2
    model = cotraining.Model.fit((text, meta), said, held & (said >= 0))
    alone, _, both = model.scores(text, meta)
    assert ((alone > 0.5) == y)[24:].mean() > 0.9 and ((both > 0.5) == y).mean() > 0.99


def test_cotraining_without_labels(spark):
    docs = docs_of(spark, [(1, "a", "en", "s")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [x.score for x in cotraining.scored(docs, none).collect()] == [1.0]
    assert cotraining.scored(docs_of(spark, []), none).count() == 0


# --- rules


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_counts(spark):
    texts = [None, "", " \n\t", "a b", "a b c a b c a b c", "x\n x\nx\n\n\nx ", "é ü\x0bö\x85 \x1c# *$%&|<>", prose("en", 1, 400), "one two three four " * 3000, "a\\b 'q' \x00 z"]
    rows = [(i, t, None if i % 2 else "en", "s") for i, t in enumerate(texts)] + [(None, "b " * 60, "de", "s"), (1, prose("fr", 2, 90), "fr", "s")]
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = rules.judged(docs_of(spark, rows), labels).collect()
    assert plain(got) == sorted(repr((i, *counted(t), not counted(t)[5])) for i, t, _, _ in rows)
    assert rules.judged(docs_of(spark, []), labels).count() == 0


def test_binomial_tail(spark):
    for k, n, p in ((0, 745, 0.01), (3, 1000, 0.01), (30, 5000, 0.01), (2, 2_000_000, 0.003), (7, 7, 0.3)):
        exact = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert spark.sql(f"SELECT {rules.binomial_cdf(f'{k}L', f'{n}L', p)}").first()[0] == pytest.approx(exact, rel=1e-6, abs=1e-300)


def test_steps_limit_false_rejection(spark):
    """The real levels: a stratum with enough labels has a step of its own, small ones share one, without labels none."""
    clean = [(i, f"{prose('en', i, 60)} w{i}", "en", "s") for i in range(400)]
    noisy = [(1000 + i, " ".join(f"{w}###" for w in prose("en", 5000 + i, 60).split()), ("en", "de", None, "fr", "es")[i % 5], "s") for i in range(100)]
    few = [(2000 + i, f"{prose('de', i, 60)} w{i}", ("de", None, "fr")[i % 3], "s") for i in range(270)]
    other = [(3000 + i, f"{prose('es', i, 60)} w{i}", "es", "s") for i in range(9)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in [*clean[:300], *few]] + [(i, 0) for i, *_ in noisy[:50]], "doc_id bigint, quality int")
    docs = docs_of(spark, [*clean, *noisy, *few, *other])
    found = {r.stratum: r for r in rules.steps(rules.measured(docs), labels).collect()}
    assert rules.least(4) == 217 and set(found) == {"en", "de", None, "fr"}
    assert (found["en"].n, found["en"].joint) == (300, False) and found["en"].step > 0
    assert all((found[s].n, found[s].joint, found[s].step) == (270, True, found["fr"].step) for s in ("de", None, "fr"))
    for r in found.values():
        assert r.rejected < rules.ALPHA * r.n
    kept = {r.doc_id: r.kept for r in rules.judged(docs, labels).collect()}
    assert not any(kept[i] for i, _, lang, _ in noisy if lang != "es") and all(kept[i] for i, _, lang, _ in noisy if lang == "es")
    assert sum(not kept[i] for i, *_ in clean) <= 8 and sum(not kept[i] for i, *_ in few) <= 6 and all(kept[i] for i, *_ in other)


def test_too_few_labels_switch_all_rules_off(spark):
    rows = [(i, f"{prose('en', i, 60)} w{i}", "en", "s") for i in range(100)] + [(500, "a### " * 60, "en", "s")]
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id bigint, quality int")
    assert [r.step for r in rules.steps(rules.measured(docs_of(spark, rows)), labels).collect()] == [None]


# --- personal data

STRICT = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def strict(text):
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(STRICT) for m in re.finditer(p, text or "") if passes(k, m[0]))
    return [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in found]


CARDS = ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112")


def personal_texts():
    texts = [None, "", "a.b@c.de_x@f.gh", "x@y.z@w.v a@b..c @c.d a@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.2.3 1.2.3", "ü 𝄞 mail é@x.yz q@ä.b me@h.org"]
    texts += [f"card {c}, +1 (234) 555-0199 or +12345 + 1 +1" + "." * 9 + "5 x" for c in CARDS] + [f"{CARDS[2]} {CARDS[2]}", "+1 234 567 8901+44 20 7946 0018", "a\x00b@c.d 1.2.3.4\x00"]
    return texts + [f"talk to user{i}@mail.example now, host 10.0.0.{i}, pay {CARDS[i % 4]} call +1 (234) 555-01{i:02}" + f", now pay {CARDS[2]} {CARDS[2]}" * (i == 30) for i in range(60)]


def test_personal_data(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(personal_texts())] + [(None, "x@y.z", "en", "s"), (1, "x@y.z", "en", "s")]
    got = personal.find(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(repr((i, [sum(s.startswith(k) for s in strict(t)) for k in personal.KINDS], hashlib.sha256(",".join(strict(t)).encode()).hexdigest())) for i, t, _, _ in rows)
    assert sorted(repr((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256)) for r in got) == want
    for r in got:
        if r.doc_id not in (None, 1):
            assert set(strict(personal_texts()[r.doc_id])) <= set(r.spans.split(",") if r.spans else [])
    assert personal.find(docs_of(spark, [])).count() == 0


def test_trees_add_what_looks_like_strict_spans(spark):
    names = ", ".join(f"{f} double" for f in personal.FEATURES if f != "kind")
    same = [1.0] * (len(personal.FEATURES) - 1)
    bad = [0.0 if f == "valid" else 1.0 for f in personal.FEATURES if f != "kind"]
    rows = [(i, 2, 5, 21, True, False, *same) for i in range(200)] + [(i, 2, 40, 56, False, True, *bad) for i in range(200)] + [(7, 2, 90, 106, False, True, *same)]
    spans = spark.createDataFrame(rows, f"row bigint, kind int, start int, end int, base boolean, free boolean, {names}")
    assert [tuple(r) for r in personal.added(spans).collect()] == [(7, 2, 90, 106)]
    assert personal.added(spans.where("base")).count() == 0


def test_personal_search_is_linear(spark):
    texts = ["a" * 300_000, "a." * 150_000 + "@", "1" * 300_000, "1 " * 150_000, "+1" + " " * 300_000, "a@" + "b." * 150_000 + "c", "1.2." * 100_000]
    found = {r.doc_id: r for r in personal.find(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert found[5].n_email == 1 and len(found) == len(texts)


# --- mixing


def test_schedule_has_less_than_one_block_of_lag(spark):
    weights = {"a": 5, "b": 3, "c": 1, "d": 1}
    docs = docs_of(spark, [(i, "x", "en", s) for i, s in enumerate("abcd")])
    slots = mixing.schedule(mixing.target_weights(mixing.source_sizes(docs), weights)).orderBy("slot").collect()
    done = dict.fromkeys(weights, 0)
    for n, s in enumerate(slots, 1):
        assert s.turn == done[s.src] and s.slot == n - 1
        done[s.src] += 1
        assert all(abs(done[k] - w * n / 10) < 1 for k, w in weights.items())
    assert done == weights


def brute_positions(rows, weights):
    size = lambda t: len((t or "").encode())
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is not None, s or ""))
    w = {s: weights.get(s, 1) for s in sources}
    total, done, slots = sum(w.values()), dict.fromkeys(sources, 0), {}
    for t in range(total):
        s = min((s for s in sources if done[s] * total // w[s] <= t), key=lambda s: (-((done[s] + 1) * -total // w[s]), sources.index(s)))
        slots[s, done[s]] = t
        done[s] += 1
    out, before = [], Counter()
    key = lambda r: (hashlib.md5((str(r[0]) if r[0] is not None else r[1] or "").encode()).hexdigest(), str(r[0]))
    for i, t, _, s in sorted(rows, key=key):
        block = before[s] // mixing.BLOCK
        out.append((i, s, before[s], block, block // w[s] * total + slots[s, block % w[s]]))
        before[s] += size(t)
    return out


def test_positions_equal_a_sequential_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "CHUNK", 1)
    rows = [(i, "x" * (i * 7 % 90), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(120)] + [(200, None, "en", "a"), (201, "", "en", None), (202, "y" * 900, "en", None), (None, "zz", "en", "a")]
    weights = {"hot": 3, "s0": 2, "unknown": 9}
    expected = sorted(map(repr, brute_positions(rows, weights)))
    assert plain(mixing.positions(docs_of(spark, rows), weights).collect()) == expected
    assert mixing.positions(docs_of(spark, [])).count() == 0


def test_mixed_keeps_rows_and_writes_them_in_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(i, "x" * (5 + i % 40), "en", f"s{i % 3}") for i in range(90)] + [(7, "twice", "en", "s0")] * 2
    docs = docs_of(spark, rows)
    mixing.mixed(docs).write.parquet(str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.columns == docs.columns and plain(back.collect()) == plain(docs.collect())
    order = back.select("doc_id", F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("int").alias("p"), "_metadata.row_index").orderBy("p", "row_index")
    slot = {r.doc_id: (r.slot, r.before) for r in mixing.positions(docs).collect() if r.doc_id != 7}
    seen = [slot[r.doc_id] for r in order.collect() if r.doc_id != 7]
    assert seen == sorted(seen)


# --- token files


def test_token_files(spark, tmp_path):
    texts = ["", None, "Hello world's 12 É é ﬁ", "日本 <|endoftext|> x", "a\x1cb  c\x85d", "q" * 3000, prose("fr", 1, 300), "same", "same"]
    rows = [(50 - i if i < 7 else 7, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id", "en", "s")]
    path = token_files.write(docs_of(spark, rows), str(tmp_path / "ids"))
    got = token_files.read(spark, path).orderBy("start").collect()
    whole, at, want = Tokenizer.from_file(token_files.TOKENIZER), 0, []
    for i, t, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    files = sorted(p for p in (tmp_path / "ids").iterdir() if p.name.startswith("part-"))
    shards = [token_files.Shard(str(p)) for p in files]
    assert sum(len(s.docs) for s in shards) == len(rows) and sum(len(s.ids) for s in shards) == at
    assert isinstance(shards[0].ids.base, np.memmap) or isinstance(shards[0].ids, np.memmap)
    empty = token_files.write(docs_of(spark, []), str(tmp_path / "none"))
    assert token_files.read(spark, empty).count() == 0


# --- pages


def page(i, extra="", main="<article>{}</article>"):
    body = f"<h1>Title {i}</h1><p>Text &amp; more {i}<br>next\n line<p><b>bold</b> end {i}{extra}"
    return (
        f"<html><head><title>t{i}</title><script>var a='</p><p>no';</script></head><body class='has-sidebar'><header>Site</header><nav><a href=/>menu {i}</a></nav>"
        f"<div class='cookie-notice'>We use cookies {i}</div>{main.format(body)}<div id='comments'><article class='comment'>nice {i}</article></div>"
        f"<aside>side {i}</aside><form><p>mail {i}</p></form><footer>&copy; {i}</footer></body></html>"
    )


def test_main_texts(spark):
    pages = [(i, f"https://A.example/{i}", page(i)) for i in range(5)]
    pages += [(10 + i, "http://b.example/x", page(i, main="<div class='post-content'>{}</div>")) for i in range(5)]
    pages += [(20 + i, "http://c.example/x", page(i, main="<div>{}</div><p>The same on every page</p><ul><li><a href=/>l " + str(i) + "</a></ul>")) for i in range(5)]
    pages += [(30, None, "<p>one<p>two"), (31, "odd", None), (32, "http://d.example/", ""), (None, "http://a.example/9", page(9)), (1, "http://a.example/1", page(1))]
    pages += [(33, "http://e.example/", "<div>" * 5000 + "deep" + "</div>" * 5000), (34, "http://f.example", "plain < 3 &lt;b&gt; &nbsp; text")]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, wrapper string")
    got = wrappers.main_texts(table).collect()
    text = lambda i: f"Title {i}\nText & more {i} next line\nbold end {i}"
    found = defaultdict(list)
    for r in got:
        found[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert len(got) == len(pages)
    for i in range(5):
        assert found[i][0] == text(i) and found[10 + i] == [text(i)] and found[20 + i] == [text(i)]
    assert found[30] == ["one\ntwo"] and found[31] == [""] and found[32] == [""] and found[None] == [text(9)] and len(found[1]) == 2
    assert found[33] == ["deep"] and found[34] == ["plain < 3 <b> text"]
    assert wrappers.main_texts(table.where("false")).count() == 0


def test_wrappers_align():
    root = None
    for html in ("<div><p>a</p><p>b</p><i>c</i></div>", "<div><h2>x</h2><p>a</p></div>", "<div><p>q</p><hr><p>z</p></div>"):
        own = wrappers.page_wrapper(wrappers.parse(html))
        root = own if root is None else wrappers._merged(root, own)
    div = root.items[0]
    assert [(wrappers._kind(x), isinstance(x, wrappers.Node) and (x.opt, x.rep)) for x in div.items][:2] == [("h2", (True, False)), ("p", (False, True))]


# --- pipeline


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    base = corpus(40)
    passage = " ".join(f"secret{k}" for k in range(20))
    rows = [*base, (100, base[3][1], "en", "s0"), (101, None, "en", "s1"), (102, "?!", "en", "s1"), (103, passage, "en", "s2"), (104, prose("en", 77, 400) + " " + passage, "en", "s2")]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    prints = {i: simhash.fingerprint(t) for i, t, _, _ in rows if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for i in sorted(prints):
        linked = {first[j] for j in first if (prints[i] ^ prints[j]).bit_count() <= 2}
        first[i] = min(linked, default=i)
        for j, f in first.items():
            first[j] = first[i] if f in linked else f
    kept = [r for r in rows if first.get(r[0]) == r[0] and r[0] != 103]
    assert {r.doc_id for r in got} == {r[0] for r in kept} and 104 in {r.doc_id for r in got}
    sizes = Counter()
    for _, t, _, s in kept:
        sizes[s] += len(t.encode())
    roots = sum(math.sqrt(n) for n in sizes.values())
    weights = {s: max(1, math.floor(mixing.PERIOD * math.sqrt(n) / roots + 0.5)) for s, n in sizes.items()}
    order = [i for i, *_ in sorted(brute_positions(kept, weights), key=lambda x: (x[4], x[2]))]
    assert [r.doc_id for r in got] == order
    whole, at = Tokenizer.from_file(token_files.TOKENIZER), 0
    for r in got:
        ids = [*whole.encode(next(t for i, t, _, _ in rows if i == r.doc_id), add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("text", [None, ""])
def test_pipeline_of_empty_tables(spark, tmp_path, text):
    rows = [] if text is None else [(1, text, None, None)]
    docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
