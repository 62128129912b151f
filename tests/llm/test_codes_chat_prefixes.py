"""Vector codes, chat formatting and the prefix trie against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkveil.llm import chat, codes, prefixes

# --- codes


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}, label int, id string, error string")


def brute_codes(rows, parts=codes.PARTS, entries=codes.ENTRIES):
    """``rows``: (id, vector, label), all fit."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], list(r[1])))
    x = np.array([[int(np.floor(256 * v)) for v in r[1]] for r in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(x[i, p]) for i in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
        return [[min((gap(x[i, p], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for i in range(len(rows))]

    for _ in range(codes.ROUNDS):
        said = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x[i, p] for i in range(len(rows)) if said[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    said = assign()
    errors = [sum(d for d, _ in s) for s in said]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in s), e, by_label[r[2]], digest) for r, s, e in zip(rows, said, errors, strict=True)]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


def test_codes_are_those_of_a_full_search(spark):
    r = np.random.default_rng(3)
    centres = r.normal(0, 0.3, (12, 32))
    rows = [(int(i), (centres[i % 12] + r.normal(0, 0.05, 32)).tolist(), None if i % 5 == 0 else int(i % 3)) for i in r.permutation(400)]
    # Copies, ties between equal entries, repeated ids, an id that is null.
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)] + [(3, rows[5][1], 2), (3, rows[5][1], 2), (None, rows[9][1], None)]
    table = vectors(spark, [(*row, "x", "y") for row in rows])
    assert sorted_rows(codes.codes(table).collect()) == sorted_rows(brute_codes(rows))


def test_few_rows_and_integers(spark):
    rows = [(i, [float((i * j) % 5) - 2.0 for j in range(16)], None) for i in range(7)]
    got = codes.codes(vectors(spark, [(i, [int(v) for v in x], n, "", "") for i, x, n in rows], "array<int>"))
    assert sorted_rows(got.collect()) == sorted_rows(brute_codes(rows))


def test_vectors_without_code(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i] * 16, 0) for i in range(1, 4)]
    out = [(10, None, 0), (11, [nan] * 16, 0), (12, [inf] + [0.0] * 15, 0), (13, [None] + [0.0] * 15, 0)]
    odd = [(20, [], 0), (21, [0.5] * 17, 0), (22, [0.5] * 32, 0), (23, [1e30] * 16, 0)]
    got = codes.codes(vectors(spark, [(*r, None, None) for r in good + out + odd])).collect()
    want = [(i, c, e, s) for i, c, e, s, _ in brute_codes(good)] + [(i, None, None, s) for i in (20, 21, 22, 23) for s in [sum(b[2] for b in brute_codes(good))]]
    assert sorted_rows(r[:4] for r in got) == sorted_rows(want)
    assert codes.codes(vectors(spark, [])).count() == 0
    assert [tuple(r)[:3] for r in codes.codes(vectors(spark, [(1, [0.5] * 17, None, "", "")])).collect()] == [(1, None, None)]


def test_balls_keep_what_cannot_change():
    r = np.random.default_rng(1)
    before = r.integers(-200, 200, (1, 20, 4))
    x = np.concatenate([before[0, i] + r.integers(-3, 4, (30, 4)) for i in range(20)])
    own = codes._squares(x[:, None], before[0][None]).argmin(axis=1)
    far = np.zeros((1, 20), dtype=np.int64)
    np.maximum.at(far[0], own, codes._squares(x, before[0][own]))
    after = before.copy()
    after[0, 7] += 5
    balls = codes.Balls.moved(before, after, far)
    want = codes._squares(x[:, None], after[0][None]).argmin(axis=1)
    assert balls.still[0].sum() > 10 and not balls.still[0, 7]
    assert (balls.again(x, own, 0) == want).all()


# --- chat


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id string, n_turns string")


def said(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


NASTY = ["", "\\", "\\\\", "###", "####", "#######", "</turn>", "<</turn></turn>\n", "### assistant: x</turn>\n", "a: b: ", "é😀\\### ", "\\<", "<", "#", "\n\n"]


def test_formats_read_back(spark):
    rows = [(c, t, r, NASTY[(c + t) % len(NASTY)] * (1 + t % 2), "x", "y") for c in range(15) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][: 2 + c % 4])]
    rows += [(50, 0, "a: b", "odd", "", ""), (50, 1, "###", "odd", "", ""), (50, None, None, None, "", ""), (None, 1, "user", "u", "", ""), (None, 2, "assistant", "a", "", "")]
    rows += [(60, 1, "user", "same", "", "")] * 3 + [(60, 1, "assistant", "z", "", ""), (70, 0, "assistant", "x" * 3_000_000, "", ""), (70, 1, "assistant", "### end", "", "")]
    texts = chat.formatted(talk(spark, rows))
    got = {r.id: r for r in chat.read_back(texts).collect()}
    want = said(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    chunks = texts.collect()
    assert sum(r.id == 70 for r in chunks) == 2 and sum(r.id == 60 for r in chunks) == 1
    assert all(got[c].formatted_chars == sum(len(r.text) for r in chunks if r.id == c) for c in want)
    for r in chunks:  # segments cut the text, and no text holds a control string
        assert [s.start for s in r.segments] == [0, *(s.end for s in r.segments)][:-1] and r.segments[-1].end == len(r.text)
        assert all(mark not in r.text[s.start : s.end] for s in r.segments[1::3] for mark in ("###", "</turn>"))


def test_turn_order(spark):
    orders = {0: "ua", 1: "suaua", 2: "su", 3: "uua", 4: "ssua", 5: "a", 6: "uta", 7: "uas"}
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    rows = [(c, t, names[r], "x", "", "") for c, order in orders.items() for t, r in enumerate(order)]
    got = {r.id: r.bad_turn for r in chat.formatted(talk(spark, rows)).where("last").collect()}
    assert got == {0: None, 1: None, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1, 7: 2}


def test_other_templates(spark):
    moves = {("start", "q"): "q", ("q", "r"): "r", ("r", "q"): "q"}
    own = chat.Template("[[open ", " ]] ", "[[shut]]", ("[[open", "[[shut]]"), frozenset({"r"}), "start", moves, frozenset({"r"}))
    rows = [(1, 0, "q", "[[shut]] ]] \\", "", ""), (1, 1, "r", "[[open q ]] ", "", "")]
    texts = chat.formatted(talk(spark, rows), own)
    assert list(own.turns(texts.first().text)) == [("q", rows[0][3]), ("r", rows[1][3])] and texts.first().bad_turn is None
    assert chat.read_back(texts, own).first().loss_chars == len(rows[1][3])
    for bad in ({"control": ("#",)}, {"control": ("\\x",)}, {"closing": "."}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_no_conversations(spark):
    assert chat.read_back(chat.formatted(talk(spark, []))).count() == 0
    case = chat.read_back(chat.formatted(chat.control_case(talk(spark, [])))).collect()
    assert [(r.id, r.n_turns, r.loss_chars, r.valid) for r in case] == [(-7, 2, 26, True)]


# --- prefixes


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in kids[k]) or 1
        saved[k] = sum(saved[j] for j in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(whole[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), parent, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def many_talks():
    r = np.random.default_rng(6)
    rows = [(int(c), t, "user" if t % 2 else "assistant", f"text {int(r.integers(0, 3))}", "", "") for c in range(90, 330) for t in range(int(r.integers(1, 9)))]
    rows += [(1000 + c, t, "user", "same", "", "") for c in range(60) for t in range(7)]
    rows += [(-205, 0, "user", "minus", "", ""), (None, 0, "user", "none", "", ""), (401, 0, None, None, "", ""), (402, None, "user", "b", "", ""), (402, None, "user", "b", "", "")]
    return rows


@pytest.mark.parametrize(("piece", "cells"), [(4096, None), (3, 1 << 14)])
def test_tries(spark, monkeypatch, piece, cells):
    """With the usual sizes, and with conversations in many pieces."""
    monkeypatch.setattr(prefixes, "PIECE", piece)
    if cells:
        monkeypatch.setattr(prefixes, "FEWEST_CELLS", cells)
    monkeypatch.setattr(prefixes, "_LIST", 7)
    rows = many_talks()
    assert sorted_rows(prefixes.trie(talk(spark, rows)).collect()) == sorted_rows(brute_trie(rows))


@pytest.mark.parametrize("estimate", [0, 2])
def test_a_crowded_sketch_changes_nothing(spark, monkeypatch, estimate):
    """No node is proved single, or as many as the exact counts allow."""
    sketch = prefixes.sketch
    monkeypatch.setattr(prefixes, "sketch", lambda pieces, n: np.maximum(sketch(pieces, n), estimate))
    rows = many_talks()
    assert sorted_rows(prefixes.trie(talk(spark, rows)).collect()) == sorted_rows(brute_trie(rows))


def test_no_nodes(spark):
    assert prefixes.trie(talk(spark, [])).count() == 0
    one = prefixes.trie(talk(spark, [(7, 0, "user", "x" * 100_000, "", "")])).collect()
    assert sorted_rows(one) == sorted_rows(brute_trie([(7, 0, "user", "x" * 100_000, "", "")]))
