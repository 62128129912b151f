"""Findings as a table, counts over it, and the highlighted preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil import catalog
from inkveil.functions.arrays import quote
from inkveil.operators.rewrite import spliced_sql

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n", "<br>"), (" ", "&nbsp;"))


def findings(spanned: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row per finding: the keys, ``type, value, start, end, prefix``.

    The array is exploded through an expression: exploding the bare column would let the
    optimizer infer a filter on it and search every text twice.
    """
    rows = spanned.select(*keys, F.explode(F.expr(f"transform(`{spans}`, x -> x)")).alias("f"))
    return rows.select(*keys, "f.type", "f.value", "f.start", "f.end", "f.prefix")


def stats(found: DataFrame, *keys: str) -> DataFrame:
    """Occurrences per type, overall or per ``keys``."""
    return found.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def total(found: DataFrame, *keys: str) -> DataFrame:
    """Replacements made in all, overall or per ``keys``."""
    return found.groupBy(*keys).agg(F.count("*").alias("total_replacements"))


def escaped_sql(text: str) -> str:
    for plain, entity in _ESCAPES:
        text = f"replace({text}, {quote(plain)}, {quote(entity)})"
    return text


def highlighted(text: str = "text", spans: str = "spans") -> Column:
    """The text as HTML with every finding in a coloured span."""
    kinds = [*catalog.TYPE_NAMES, catalog.CUSTOM]
    table = "map(" + ", ".join(
        f"{quote(kind)}, struct({quote(catalog.COLORS[kind])} as color, {quote(catalog.LABELS[kind])} as label)"
        for kind in kinds
    ) + ")"
    mark = (
        f"concat('<span class=\"detection\" data-type=\"', e.type, '\" style=\"background-color: ', {table}[e.type].color, "
        f"'20; border-bottom: 2px solid ', {table}[e.type].color, "
        f"'; padding: 1px 2px; border-radius: 2px;\" title=\"', {table}[e.type].label, '\">', {escaped_sql('e.value')}, '</span>')"
    )
    return F.expr(spliced_sql(f"`{text}`", f"`{spans}`", between=escaped_sql("{part}"), replacement=mark))


def preview(spanned: DataFrame, text: str = "text", spans: str = "spans", out: str = "html") -> DataFrame:
    """Add the highlighted HTML; nothing is numbered."""
    return spanned.withColumn(out, highlighted(text, spans))
