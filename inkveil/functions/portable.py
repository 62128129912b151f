"""Which user regexes mean the same to the JVM's engine and to Python's, and are safe there.

A pattern is portable if it is made of literals, simple classes, ``.``, the usual class escapes and word
boundaries, with repeats of single characters or bounded repeats of uncaptured groups, and if every
alternative takes at least one character. Left out are, for instance: capturing groups (the JVM gives no group
positions), unbounded repeats of groups (the JVM's engine recurses), lookarounds, ``\\Z`` and ``$``, nested or
intersected classes, ``{,n}``, and whatever can match nothing. Those patterns are searched by Python.
"""

from __future__ import annotations

import re

MOST_REPEATS = 64
_ESCAPED = re.compile(r"\\(?:[dDwWsS]|[^\w\s])")
_CLASS = re.compile(r"\[\^?(?:\\(?:[dDwWsS]|[^\w\s])|[^\[\]\\&~|^-]|-(?!-))+\]")
_REPEAT = re.compile(r"(?:[*+?]|\{(\d+)(,?)(\d*)\})\??(?![*+?{])")


def portable(regex: str) -> bool:
    found = _alternatives(regex, 0)
    return found is not None and found[0] == len(regex) and found[1]


def _alternatives(regex: str, at: int) -> tuple[int, bool] | None:
    """Where the alternatives from ``at`` end, and whether each takes a character; None if not portable."""
    every, some = True, False
    while at < len(regex) and regex[at] != ")":
        c = regex[at]
        if c == "|":
            every, some, at = every and some, False, at + 1
            continue
        if regex.startswith((r"\b", r"\B"), at):
            if _REPEAT.match(regex, at + 2):
                return None
            at += 2
            continue
        taken, group = True, False
        if regex.startswith("(?:", at):
            inside = _alternatives(regex, at + 3)
            if inside is None or not regex.startswith(")", inside[0]):
                return None
            at, taken, group = inside[0] + 1, inside[1], True
        elif match := (_ESCAPED.match(regex, at) if c == "\\" else _CLASS.match(regex, at) if c == "[" else None):
            at = match.end()
        elif c in "\\[](){}*+?^$":
            return None
        else:
            at += 1
        if at < len(regex) and regex[at] in "*+?{":
            match = _REPEAT.match(regex, at)
            if match is None:
                return None
            least, comma, most = match.groups()
            low = 1 if match[0][0] == "+" else int(least or 0)
            if least is not None:
                unbounded = bool(comma) and not most
                bound = int(most) if most else low
            else:
                unbounded, bound = match[0][0] in "*+", 1
            if group and (unbounded or bound > MOST_REPEATS):
                return None
            taken, at = taken and low > 0, match.end()
        some = some or taken
    return at, every and some
