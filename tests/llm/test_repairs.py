"""Cases that earlier versions of the operators got wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkveil.llm import cotraining, lines, postings, token_files, workers, wrappers
from tests.llm.test_models import docs_of, prose

# --- co-training


def auc(score, y):
    order = np.argsort(np.argsort(score))
    good = int(y.sum())
    return (order[y == 1].sum() - good * (good - 1) / 2) / (good * (len(y) - good))


def views(n, seed, clear=1.0):
    """A text view that tells good from bad, a metadata view of pure noise."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.8).astype(np.int64)
    text = r.normal(0, 0.05, (n, cotraining.BUCKETS)).astype(np.float32)
    text[:, 0] += clear * (y - 0.5)
    return (text, r.normal(size=(n, cotraining.META)).astype(np.float32)), y


def test_a_view_without_a_word_to_say_changes_nothing():
    (text, meta), y = views(1500, 1, 0.4)
    said = np.where(np.arange(1500) < 700, y, -1)
    held = (np.arange(1500) % 4 == 0) & (said >= 0)
    (t, m), truth = views(1000, 2, 0.4)
    alone, model = (cotraining.Model.fit((text, meta), said, held, rounds=k) for k in (0, cotraining.ROUNDS))
    both = model.scores(t, m)
    assert all(abs(a) < 50 for a, _ in model.curves) and model.curves[1][0] < 0.2 * model.curves[0][0]
    assert auc(both[2], truth) > auc(alone.scores(t, m)[0], truth) - 0.01
    assert len(np.unique(both[2].round(6))) > 500


def test_curves_stay_flat_on_noise():
    for seed in range(20):
        r = np.random.default_rng(seed)
        a, b = cotraining._curve(r.normal(size=300), (r.random(300) < 0.8).astype(np.int64), np.ones(300))
        assert 0 <= a < 1 and abs(1 / (1 + np.exp(-b)) - 0.8) < 0.15


def test_separable_margins_give_a_bounded_curve():
    y = np.array([0] * 50 + [1] * 50)
    a, b = cotraining._curve(np.where(y > 0, 1.0, -1.0), y, np.ones(100))
    assert 1 < a < 50 and abs(b) < 1


def test_a_rare_class_is_drawn_whole(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "LABELLED", 60)
    monkeypatch.setattr(cotraining, "FLOOR", 20)
    monkeypatch.setattr(cotraining, "POOL", 30)
    seen = []
    fit = cotraining.Model.fit
    monkeypatch.setattr(cotraining.Model, "fit", staticmethod(lambda v, y, held, **k: seen.append((y, k)) or fit(v, y, held, **k)))
    rows = [(i, prose("de" if i < 8 else "en", i), "en", "s") for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i >= 8), 0) for i in range(900)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r.score for r in cotraining.scored(docs_of(spark, rows), labels).collect()}
    y, given = seen[0]
    assert (y == 0).sum() == 8 and (y == 1).sum() == 59 and (y < 0).sum() == 30 and given["prior"] == 892 / 900
    assert len({round(s, 9) for s in found.values()}) > 500


# --- contamination


def test_nulls_do_not_meet_other_rows(spark):
    docs = spark.createDataFrame([("7", None), (None, "7"), ("8", "seven")], "doc_id string, text string")
    tests = spark.createDataFrame([("i", "7")], "item_id string, text string")
    assert sorted(postings.clean(docs, tests).collect(), key=repr) == sorted([("7", None), ("8", "seven")], key=repr)


# --- token files


def test_end_ids_that_the_sink_would_change_are_refused(spark, tmp_path):
    docs = docs_of(spark, [(1, "a", "en", "s")])
    for end in (200, 128, 1 << 15):
        with pytest.raises(ValueError):
            token_files.write(docs, str(tmp_path / str(end)), end=end)
    token_files.write(docs, str(tmp_path / "ok"), end=127)
    shard = [p for p in (tmp_path / "ok").glob("part-*") if p.stat().st_size > 50]
    assert [int(token_files.Shard(str(p)).ids[-1]) for p in shard if len(token_files.Shard(str(p)).ids)] == [127]


def test_words_are_cut_as_the_tokenizer_cuts_them(monkeypatch):
    signs = [*"abcXYZ'’–— \t\n.,-!?019sStTmMdDrReEvVlL", "'s", "'LL", *"ÄÖé×÷²½ªº", *"İȺƏƁ\x85\xa0\x00\x1b\x1c", "re", "ve", "<|", *"ſ中\u0307"]
    draw = random.Random(3)
    texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(3000)]
    texts += [f"a{chr(c)}b'{chr(c)}" for c in range(0x250)] + ["", "'l", "don't'", "x " * 5000 + "y'"]
    whole = Tokenizer.from_file(token_files.TOKENIZER)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    encoder = token_files.Encoder(token_files.TOKENIZER, "<u2")
    assert encoder.by_word and encoder(texts) == want
    monkeypatch.setattr(token_files, "_PIECE", 7)
    assert encoder(texts) == want


def test_words_are_forgotten_in_time(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(20)]
    whole = token_files.Encoder(token_files.TOKENIZER, "<u2")
    want = whole(texts)
    for name, bound in (("_KNOWN", 500), ("_KNOWN_BYTES", 4000)):
        monkeypatch.setattr(token_files, name, bound)
        encoder = token_files.Encoder(token_files.TOKENIZER, "<u2")
        assert [x for t in texts + texts[:9] for x in encoder([t])] == want + want[:9] and len(encoder.known) + len(encoder.before) < 1600
        monkeypatch.undo()


def test_workers_keep_one_model():
    made = []
    make = lambda: made.append(1) or object()
    assert workers.kept(("a",), make) is workers.kept(("a",), make) and len(made) == 1
    assert list(workers.frugal(lambda batches: iter(batches), keeps=True)([1, 2])) == [1, 2] and workers.kept(("a",), make) and len(made) == 1
    assert list(workers.frugal(lambda batches: iter(batches))([3])) == [3]
    workers.kept(("a",), make)
    workers.kept(("b",), make)
    assert len(made) == 3 and list(workers._KEPT) == [("b",)]


# --- pages

KEPT = {
    "entry header": '<header class="entry-header"><h1>Title {i}</h1></header><p>text {i} is prose</p>|Title {i}\ntext {i} is prose',
    "code comments": '<pre>code {i} <span class="hljs-comment"># note {i}</span> <span class="token comment">// c</span></pre>|code {i} # note {i} // c',
    "share link": '<p>say {i} <a class="share-link" href=/>this word</a> and go on</p>|say {i} this word and go on',
    "banner": '<p class="banner">news {i} of the day</p><p>more {i}</p>|news {i} of the day\nmore {i}',
    "related work": '<div class="related-work"><p>Others {i} did this before</p></div><p>more {i}</p>|Others {i} did this before\nmore {i}',
    "section header": '<h2 class="section header">Part {i}</h2><p>more {i}</p>|Part {i}\nmore {i}',
    "related links": '<p>prose {i} here</p><div class="related"><a href=/>a link {i}</a> <a href=/>another</a></div>|prose {i} here',
    "comments": '<p>prose {i} here</p><div class="comments"><p>I say {i} no</p></div>|prose {i} here',
    "advert": '<p>prose {i} here</p><div class="ad">Buy {i} now</div>|prose {i} here',
}


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("whole", ["<article>{}</article>", "<div class=x>{}</div>"])
def test_names_alone_cut_no_text(spark, n, whole):
    rows = []
    for k, case in enumerate(KEPT.values()):
        html = case.split("|")[0]
        page = "<nav><a href=/>home</a></nav>" + whole.format(html) + "<footer>f</footer>"
        rows += [(100 * k + i, f"http://h{k}.example/{i}", page.replace("{i}", str(i))) for i in range(n)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(table).collect()}
    want = {100 * k + i: case.split("|")[1].replace("{i}", str(i)) for k, case in enumerate(KEPT.values()) for i in range(n)}
    assert got == want


def test_the_host_decides(spark):
    """The same pages read beside others of their host: template goes, also long one, and a box with a teaser is no article."""
    legal = "The same long words on every page. " * 12
    first = [f"<div class=a><p>{legal}</p></div><div class=b><h1>Story {i}</h1><p>Something {i} happened.</p></div>" for i in range(6)]
    there = "Something {i} happened there. " * 20
    second = [f"<div class=content><p>Read on {i}.</p></div><div class=x><h1>Story {i}</h1><p>{there.replace('{i}', str(i)).strip()}</p></div>" for i in range(6)]
    rows = [(i, "http://a.example/", h) for i, h in enumerate(first)] + [(10 + i, "http://b.example/", h) for i, h in enumerate(second)] + [(20, "http://c.example/", first[0])]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nSomething {i} happened." for i in range(6))
    assert all(got[10 + i] == f"Read on {i}.\nStory {i}\n" + there.replace("{i}", str(i)).strip() for i in range(6))
    assert got[20].startswith("The same long words")


# --- lines


def test_many_documents_without_an_id(spark):
    """Their lines are gathered text by text, not all under one id."""
    line = "the very same line that stands everywhere {k}"
    rows = [(None if i % 2 else 7, f"{line.format(k=i % 9)}\nown words of number {i} here", "en", f"s{i}") for i in range(200)]
    docs = docs_of(spark, rows)
    sizes = lines.occurrences(docs).groupBy("doc_id", "content").agg(F.collect_set("h").alias("hs")).select(F.max(F.size("hs"))).first()[0]
    assert sizes == 2
    got = sorted(r.text for r in lines.cleaned(docs).collect())
    assert got == sorted(f"own words of number {i} here" for i in range(200))
