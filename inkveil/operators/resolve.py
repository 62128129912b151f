"""Overlap resolution: which candidates of a document survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.arrays import cut_at, indexes, let
from inkveil.operators.candidates import CANDIDATES

SPANS = "array<struct<start:int,end:int,type:string,prefix:string,value:string>>"

_OVERLAP = "(e.end > x.start and e.start < x.end)"
_X_COVERS = "(x.start <= e.start and x.end >= e.end)"
_E_COVERS = "(e.start <= x.start and e.end >= x.end)"
_X_LONGER = "(x.end - x.start > e.end - e.start)"

#: So many candidates are settled together: among few, looking at all kept ones costs less than grouping them.
FEW = 16


def _settled(cluster: str) -> str:
    """Let candidates in one after another, in rank order.

    A newcomer is refused when a kept finding covers it, or overlaps it in part and is at
    least as long; otherwise it replaces every kept finding it overlaps. On equal spans
    the newcomer covers, so the later rank wins.
    """
    refused = f"exists(kept, e -> {_OVERLAP} and not {_X_COVERS} and ({_E_COVERS} or not {_X_LONGER}))"
    admitted = f"concat(filter(kept, e -> not {_OVERLAP}), array(x))"
    return (
        f"aggregate(sort_array({cluster}), cast(array() as {CANDIDATES}), "
        f"(kept, x) -> if({refused}, kept, {admitted}))"
    )


def spans_sql(candidates: str) -> str:
    """Surviving findings, disjoint and ordered by start.

    Candidates that overlap directly or through others form a group, found by sorting: the
    i-th by start opens a group exactly when the i-1 smallest ends all lie at or before its
    start. Groups are settled apart, so the work follows their sizes. A few candidates are one group, as findings
    that do not overlap leave each other alone.
    """
    span = "struct({0}.start, {0}.end, {0}.type, {0}.prefix, {0}.value)"
    few = f"sort_array(transform({_settled(candidates)}, x -> {span.format('x')}))"
    by_start = f"sort_array(transform({candidates}, x -> struct(x.start as s, x as c)))"
    ends = f"sort_array(transform({candidates}, x -> x.end))"
    opens = f"filter({indexes('1', 'size(ends) - 1')}, i -> ends[i - 1] <= by_start[i].s)"
    alone = f"transform(by_start, y -> {span.format('y.c')})"
    groups = cut_at("by_start", "concat(array(0), opens)")
    group = f"if(size(g) = 1, transform(g, y -> y.c), {_settled('transform(g, y -> y.c)')})"
    settled = f"flatten(transform({groups}, g -> {group}))"
    apart = f"sort_array(transform({settled}, x -> {span.format('x')}))"
    spans = let(
        "by_start",
        by_start,
        let("ends", ends, let("opens", opens, f"if(size(opens) = size(ends) - 1, {alone}, {apart})")),
    )
    return f"if(size({candidates}) = 0, cast(array() as {SPANS}), cast(if(size({candidates}) <= {FEW}, {few}, {spans}) as {SPANS}))"


def resolve(candidates: str) -> Column:
    return F.expr(let("cands", f"`{candidates}`", spans_sql("cands")))


def with_spans(df: DataFrame, candidates: str = "candidates", out: str = "spans") -> DataFrame:
    """Replace the candidate array by the array of surviving findings."""
    return df.withColumn(out, resolve(candidates)).drop(candidates)
