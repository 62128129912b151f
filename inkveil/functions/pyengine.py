"""Matching with Python's regex engine, in Arrow batches.

For custom patterns that are not portable, as the
independent check of the JVM expressions in tests, and for short ASCII texts, where both find the same: one
scan of a batch by Arrow's linear engine tells which texts may hold a type, and only those meet its pattern.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Ship this module's functions inside the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCATED = "struct<ord:int,start:int,end:int,value:string>"


def spans(regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Span of the first group that took part in each match, or of the whole match; empty ones are none."""
    found = []
    for match in regex.finditer(text):
        group = next((g for g in range(1, regex.groups + 1) if match.group(g) is not None), 0)
        if match.start(group) < match.end(group):
            found.append(match.span(group))
    return found


def finder(patterns: Sequence[tuple[int, str]]) -> Callable[[Column], Column]:
    """A vectorised function: text to located findings of all ``(ord, regex)``."""
    fixed = list(patterns)

    @F.pandas_udf(f"array<{LOCATED}>")
    def find(texts: pd.Series) -> pd.Series:
        compiled = [(ord_, re.compile(regex, re.IGNORECASE)) for ord_, regex in fixed]
        rows = []
        for text in texts:
            rows.append(
                [
                    {"ord": ord_, "start": start, "end": end, "value": text[start:end]}
                    for ord_, regex in compiled
                    for start, end in spans(regex, text or "")
                ]
            )
        return pd.Series(rows)

    return find


#: Texts of up to so many bytes are short: patterns that look again from every word cost little there, some 1.2 seconds at worst.
SHORT_BYTES = 32 << 10
_MARK = "\x00"


@dataclass(frozen=True)
class Short:
    """How a type is found in short ASCII texts.

    ``guards`` are necessary conditions, as Arrow's regexes. ``plain``, ``(lead, value)``, is a form of the pattern without
    looking around that Arrow's engine knows: it finds the same in texts where ``unless`` does not hold.
    """

    ord: int
    regex: str
    guards: tuple[str, ...]
    plain: tuple[str, str] | None = None
    unless: str | None = None


def is_short(text: str) -> str:
    return f"octet_length({text}) <= {SHORT_BYTES} and octet_length({text}) = length({text}) and not contains({text}, '\\u0000')"


def _marked(texts: pa.Array, plain: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, start, end and value of each match: matches are bracketed, and lengths of what lies between add up."""
    lead, value = plain
    bracketed = pc.replace_substring_regex(texts, f"(?i)({lead})({value})", f"\\1{_MARK}\\2{_MARK}")
    parts = pc.split_pattern(bracketed, _MARK)
    pieces, sizes = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy()
    first = np.cumsum(sizes) - sizes
    lengths = pc.binary_length(pieces).to_numpy().astype("int64")
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(sizes)), sizes)
    base = (ends - lengths)[first][row]
    hit = np.flatnonzero((np.arange(len(lengths)) - first[row]) % 2)
    return row[hit], (ends - lengths - base)[hit], (ends - base)[hit], pieces.take(pa.array(hit))


def _searched(texts: pa.Array, regex: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    compiled, rows, starts, ends, values = re.compile(regex, re.IGNORECASE), [], [], [], []
    for row, text in enumerate(texts.to_pylist()):
        for start, end in spans(compiled, text):
            rows.append(row)
            starts.append(start)
            ends.append(end)
            values.append(text[start:end])
    return np.array(rows, "int64"), np.array(starts, "int64"), np.array(ends, "int64"), pa.array(values, pa.string())


def short_finder(types: Sequence[Short]) -> Callable[[Column], Column]:
    """A vectorised function: short ASCII text to located findings of all ``types``; null stays null."""
    fixed = list(types)

    @F.arrow_udf(f"array<{LOCATED}>")
    def find(texts: pa.Array) -> pa.Array:
        found = []
        for kind in fixed:
            may = functools.reduce(pc.and_, [pc.match_substring_regex(texts, guard) for guard in kind.guards])
            odd = may
            if kind.plain is not None:
                odd = pc.and_(may, pc.match_substring_regex(texts, kind.unless)) if kind.unless else pc.and_(may, False)
                found.append((kind.ord, pc.indices_nonzero(pc.and_not(may, odd)), kind.plain))
            found.append((kind.ord, pc.indices_nonzero(odd), kind.regex))
        hits = []
        for ord_, at, how in found:
            if len(at):
                row, start, end, value = (_searched if isinstance(how, str) else _marked)(texts.take(at), how)
                hits.append((at.to_numpy().astype("int64")[row], np.full(len(row), ord_), start, end, value))
        if not hits:
            hits = [(*[np.array([], "int64")] * 4, pa.array([], pa.string()))]
        rows, ords, starts, ends = (np.concatenate([h[i] for h in hits]) for i in range(4))
        order = np.argsort(rows, kind="stable")
        columns = [pa.array(c[order].astype("int32")) for c in (ords, starts, ends)]
        columns.append(pa.concat_arrays([h[4] for h in hits]).take(pa.array(order)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype("int32")
        items = pa.StructArray.from_arrays(columns, ["ord", "start", "end", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets), items, mask=texts.is_null())

    return find
