"""All matches of a regex with their positions, from one regex pass inside the JVM.

Spark has no function that returns match offsets. Each match is bracketed by a separator
(``regexp_replace`` with ``$0``) and the marked text is split on it: pieces then alternate
gap, match, gap, ..., gap, and offsets are running sums of their lengths.
"""

from __future__ import annotations

import re

from inkveil.functions.arrays import indexes, let, quote, running_sums

SEPARATOR = "\x00"

HITS = "array<struct<ord:int,gap:int,mlen:int,lead:int,value:string>>"


def jvm_regex(pattern: str) -> str:
    """Flags that give a JVM regex Python's case folding, Unicode classes and ``$`` rule.

    Python also counts U+001C..U+001F as white space, hence the wider ``\\s`` class.
    """
    return "(?iUd)" + pattern.replace(r"\s", r"\s\x1c-\x1f")


_ESCAPES = {"s": " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", "d": "0123456789", "n": "\n", "r": "\r", "t": "\t"}
_CLASS = re.compile(r"\\.|\[(\^?)((?:\\[^DSWbw]|[^\]\\])+)\]")
_MEMBER = re.compile(r"(\\x[0-9a-f]{2}|\\.|[^\\])(?:-(\\x[0-9a-f]{2}|\\.|[^\\]))?", re.S)


def ascii_regex(pattern: str) -> str:
    """What finds the same as ``jvm_regex`` in ASCII texts, in a fraction of the time.

    Unicode folding and classes make no difference there, and a class whose characters are listed one by one is a table
    for the JVM, where ranges are compared in turn.
    """
    return "(?id)" + _CLASS.sub(lambda m: f"[{m[1]}{''.join(_listed(m[2]))}]" if m[2] else m[0], pattern)


def _listed(members: str) -> list[str]:
    """The characters of a class, escaped; a letter stands for both cases, as the flag says."""
    found: set[str] = set()
    for low, high in _MEMBER.findall(members):
        if high:
            found.update(chr(c).lower() for c in range(ord(_member(low)), ord(_member(high)) + 1))
        else:
            found.update(_member(low).lower())
    return [f"\\x{ord(c):02x}" for c in sorted(found)]


def _member(spelled: str) -> str:
    if spelled.startswith("\\x"):
        return chr(int(spelled[2:], 16))
    return _ESCAPES.get(spelled[1], spelled[1]) if spelled.startswith("\\") else spelled


def jvm_custom_regex(pattern: str) -> str:
    """The same flags for a user regex; only the named-group syntax differs."""
    return "(?iUd)" + pattern.replace("(?P<", "(?<")


def holds_separator(text: str) -> str:
    return f"contains({text}, {quote(SEPARATOR)})"


def pieces(text: str, regex: str, marked_text: str | None = None, plain: tuple[str, str] | None = None) -> str:
    """``[gap, match, gap, ..., gap]``; one element when nothing matches.

    ``marked_text`` is a boolean that tells whether the text holds the separator, if known; ``plain`` a boolean and the
    regex that finds the same where it is true.
    """
    pattern, mark = quote(regex), quote(SEPARATOR)
    bracket = quote(SEPARATOR + "$0" + SEPARATOR)
    marked = f"regexp_replace({text}, {pattern}, {bracket})"
    if plain is not None:
        marked = f"if({plain[0]}, regexp_replace({text}, {quote(plain[1])}, {bracket}), {marked})"
    # A text that holds the separator itself is matched and split in two passes instead.
    paired = (
        f"flatten(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), "
        "(gap, hit) -> if(hit is null, array(gap), array(gap, hit))))"
    )
    return f"if({marked_text or holds_separator(text)}, {paired}, split({marked}, {mark}, -1))"


def hits(
    text: str,
    regex: str,
    ord_: int,
    guard: str | None = None,
    split: str | None = None,
    marked_text: str | None = None,
    plain: tuple[str, str] | None = None,
) -> str:
    """One element per match plus one for the text after the last; empty without a match.

    ``guard`` is a cheap necessary condition. ``value`` is null in the closing element.
    """
    found = pieces(text, regex, marked_text, plain)
    if guard is not None:
        found = f"if({guard}, {found}, null)"
    hit = "get(p, 2 * i + 1)"
    lead, value = "0", hit
    if split is not None:
        lead = f"coalesce(length(regexp_extract({hit}, {quote(split)}, 1)), 0)"
        value = f"coalesce(nullif(regexp_extract({hit}, {quote(split)}, 2), ''), {hit})"
    element = (
        f"named_struct('ord', {ord_}, 'gap', length(p[2 * i]), 'mlen', coalesce(length({hit}), 0), "
        f"'lead', {lead}, 'value', {value})"
    )
    each = f"transform({indexes('0', 'cast(size(p) div 2 as int)')}, i -> {element})"
    return let("p", found, f"if(coalesce(size(p) > 1, false), {each}, cast(array() as {HITS}))")


def located(all_hits: str, text_length: str) -> str:
    """Hits of one or several regexes over one text, with ``start`` and ``end``.

    The gaps and matches of one regex add up to the text length, so one running sum over
    the concatenated hits serves all of them, modulo that length. Closing elements go.
    """
    sums = running_sums("transform(h, x -> cast(x.gap + x.mlen as bigint))")
    start = f"cast((ends[i] - x.mlen) % greatest({text_length}, 1) as int) + x.lead"
    placed = (
        "transform(h, (x, i) -> named_struct('ord', x.ord, "
        f"'start', {start}, 'end', {start} + length(x.value), 'value', x.value))"
    )
    kept = f"filter({let('ends', sums, placed)}, x -> x.value <> '')"
    return let("h", all_hits, kept)
