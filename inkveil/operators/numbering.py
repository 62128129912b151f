"""Per-document grouping of findings by value, and numbering inside one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.arrays import indexes, let, runs

EDITS = "array<struct<start:int,end:int,replacement:string>>"
VALUES = "array<struct<value:string,last:int,prefix:string,at:array<struct<start:int,end:int>>>>"
NUMBERED = "array<struct<value:string,placeholder:string,prefix:string,n:bigint,last:int>>"


def placeholder_sql(prefix: str, n: str) -> str:
    """``[PREFIX_001]``, wider past 999."""
    digits = f"cast({n} as string)"
    return f"concat('[', {prefix}, '_', if({n} > 99, {digits}, lpad({digits}, 3, '0')), ']')"


def values_sql(spans: str) -> str:
    """Findings grouped by value: where each occurs, and the prefix of its last occurrence."""
    ordered = f"sort_array(transform({spans}, x -> struct(x.value, x.start, x.end, x.prefix)))"
    entry = (
        "struct(g[0].value as value, element_at(g, -1).start as last, element_at(g, -1).prefix as prefix, "
        "transform(g, x -> struct(x.start, x.end)) as at)"
    )
    groups = f"transform({runs('by_value', 'pq.p.value <> pq.q.value')}, g -> {entry})"
    once = "transform(by_value, x -> struct(x.value as value, x.start as last, x.prefix as prefix, array(struct(x.start, x.end)) as at))"
    repeated = f"exists({indexes('1', 'size(by_value) - 1')}, i -> by_value[i - 1].value = by_value[i].value)"
    return f"cast({let('by_value', ordered, f'if({repeated}, {groups}, {once})')} as {VALUES})"


def values_of(spans: str = "spans") -> Column:
    return F.expr(values_sql(f"`{spans}`"))


def numbered_sql(values: str) -> str:
    """Number the values of one document per prefix, the last one in the text first."""
    ordered = f"sort_array(transform({values}, x -> struct(x.prefix, -x.last as back, x.value, x.at)))"
    groups = runs(ordered, "pq.p.prefix <> pq.q.prefix")
    entry = (
        "named_struct('value', x.value, 'placeholder', " + placeholder_sql("x.prefix", "i + 1") + ", "
        "'prefix', x.prefix, 'n', cast(i + 1 as bigint), 'last', -x.back, 'at', x.at)"
    )
    return f"flatten(transform({groups}, g -> transform(g, (x, i) -> {entry})))"


def edits_sql(items: str, replacement: str) -> str:
    """Occurrences of ``items`` (each with ``at``) as replacements ordered by position."""
    each = f"transform({items}, v -> transform(v.at, s -> struct(s.start, s.end, {replacement})))"
    return f"cast(sort_array(flatten({each})) as {EDITS})"


def document_edits_sql(spans: str) -> str:
    """Edits that number the findings of one document."""
    numbered = let("vals", values_sql(spans), numbered_sql("vals"))
    return let("numbered", numbered, edits_sql("numbered", "v.placeholder"))


def with_document_numbers(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Add ``mapping`` and ``edits`` of each document on its own: no join, no shuffle."""
    entries = "transform(numbered, x -> struct(x.value, x.placeholder, x.prefix, x.n, x.last))"
    both = let(
        "numbered",
        let("vals", values_sql(f"`{spans}`"), numbered_sql("vals")),
        f"struct(cast({entries} as {NUMBERED}) as mapping, {edits_sql('numbered', 'v.placeholder')} as edits)",
    )
    df = df.withColumn("__both", F.expr(both))
    return df.withColumns({"mapping": F.col("__both.mapping"), "edits": F.col("__both.edits")}).drop("__both")
