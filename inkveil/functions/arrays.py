"""Array expressions, as Spark SQL text, that keep per-document work near linear in one row.

Expressions are composed as SQL text because they nest many lambdas: one parse of the text
is far cheaper than a driver round trip per Column call.
"""

from __future__ import annotations

BLOCK = 64
CHUNK = 4096


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\x00", "\\u0000") + "'"


def strings(values: list[str]) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row under ``name``.

    A lambda body runs once per array element, and the optimizer may fold a projected
    column into it; binding through a one-element array keeps the value computed once.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def indexes(first: str, last: str) -> str:
    """``first..last`` inclusive, empty when ``last < first`` (``sequence`` would count down)."""
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() as array<int>))"


def running_sums(values: str) -> str:
    """Inclusive running sums of an ``array<bigint>``.

    Sums inside blocks of 64, then over the block totals, twice over: a single fold would
    copy its growing result at every step and be quadratic in the array.
    """
    return _running_sums(values, level=3)


def _running_sums(values: str, level: int) -> str:
    v, blocks, totals = f"v{level}", f"blocks{level}", f"totals{level}"

    def fold(block: str) -> str:
        return (
            f"aggregate({block}, cast(array() as array<bigint>), (acc, x) -> "
            "concat(acc, array(x + coalesce(get(acc, size(acc) - 1), 0L))))"
        )

    if level == 0:
        return fold(values)
    cut = (
        f"transform({indexes('0', f'cast((size({v}) - 1) div {BLOCK} as int)')}, "
        f"b -> {fold(f'slice({v}, b * {BLOCK} + 1, {BLOCK})')})"
    )
    inner = _running_sums(f"transform({blocks}, b -> element_at(b, -1))", level - 1)
    joined = (
        f"flatten(transform({blocks}, (b, i) -> "
        f"transform(b, x -> x + coalesce(get({totals}, i - 1), 0L))))"
    )
    blocked = let(blocks, cut, let(totals, inner, joined))
    return let(v, values, f"if(size({v}) <= {BLOCK}, {fold(v)}, {blocked})")


def cut_at(items: str, starts: str) -> str:
    """Slices of ``items`` that begin at each index of ``starts`` (ascending, from 0)."""
    return let(
        "cuts",
        f"concat({starts}, array(size({items})))",
        f"transform({indexes('0', 'size(cuts) - 2')}, "
        f"j -> slice({items}, cuts[j] + 1, cuts[j + 1] - cuts[j]))",
    )


def runs(items: str, differs: str) -> str:
    """Cut sorted ``items`` where ``differs``, a condition on elements ``pq.p`` and ``pq.q``, holds."""
    apart = differs.replace("pq.p", "get(a, i - 1)").replace("pq.q", "get(a, i)")
    starts = f"filter({indexes('0', 'size(a) - 1')}, i -> i = 0 or {apart})"
    return let("a", items, cut_at("a", starts))


def chunks(text: str) -> str:
    """The text cut every 4,096 characters, so that slices need not scan from its start."""
    return f"if(length({text}) <= {CHUNK}, array({text}), regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0))"


def slice_chunks(parts: str, start: str, end: str) -> str:
    """Characters ``start`` (inclusive) to ``end`` (exclusive) of a text cut by ``chunks``."""
    first, last = f"cast(({start}) div {CHUNK} as int)", f"cast((({end}) - 1) div {CHUNK} as int)"
    head = f"substring({parts}[{first}], ({start}) % {CHUNK} + 1, {CHUNK})"
    tail = f"substring({parts}[{last}], 1, (({end}) - 1) % {CHUNK} + 1)"
    within = f"substring({parts}[{first}], ({start}) % {CHUNK} + 1, ({end}) - ({start}))"
    between = f"array_join(slice({parts}, {first} + 2, {last} - {first} - 1), '')"
    return (
        f"case when ({end}) <= ({start}) then '' when {first} = {last} then {within} "
        f"else concat({head}, {between}, {tail}) end"
    )
