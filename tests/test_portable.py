import re

import pytest

from inkveil import Config, find
from inkveil.functions.portable import portable

SAFE = [r"SRV-[A-Z0-9]+", "a*b", "(?:ab|c){1,3}d", r"\d{3}-\d+?", r"[\w.-]+@x", r"\b\d+\b", "é+", r'token = "[0-9a-f]{40}"', "a{2,}b?", "ab|c"]
OTHER = [
    "(?:ab|c)+d", "[^[]+x", "x{,3}y", r"end\Z", r"\b(?=a)|ab", "a*", "a|b*", "(a)b", "a++", "[a&&b]", "(?:a", "a)", "x{2}{3}", "", "a||b", "[]a]+", "^a", "(?i)a",
    "[a-z--b]+", r"\1a", "a$",
]

TEXTS = ["ab abcabd SRV-9Z x{,3}y xy xxy", "end\n", "end", "ab\x00ab", "a]b[x 123-45 a1@x", "cccd " + "abc" * 1_000 + "d", "", None]


@pytest.mark.parametrize("regex", SAFE)
def test_portable(regex):
    assert portable(regex)


@pytest.mark.parametrize("regex", OTHER)
def test_not_portable(regex):
    assert not portable(regex)


def test_custom_patterns_find_what_python_finds(docs):
    df = docs(*TEXTS)
    for regex in ["a*b", "(?:ab|c){1,3}d", "ab|c", "(?:ab|c)+d", "[^[]+x", "x{,3}y", r"end\Z", r"\b(?=a)|ab", "(a)b"]:
        config = Config.of([], custom=[(regex, "X")])
        got = sorted((r.doc_id, r.start, r.end) for r in find(df, config, ["doc_id"]).collect())
        want = [(i, *m.span(m.re.groups)) for i, t in enumerate(TEXTS) for m in re.finditer(regex, t or "", re.I) if m.end() > m.start()]
        assert got == sorted(want), regex
