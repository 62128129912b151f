"""Putting original values back where texts mention placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkveil.functions import matching, pyengine
from inkveil.functions.arrays import let
from inkveil.functions.lineage import written
from inkveil.operators.mapping import doc_column, scope_column
from inkveil.operators.numbering import EDITS, values_of
from inkveil.operators.resolve import SPANS
from inkveil.operators.rewrite import apply_edits, edits_by_lookup

TOKEN = r"\[[^\[\]]+_[0-9]{3,}\]"


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add every placeholder-shaped token of the text, with its position, as spans.

    Short ASCII texts are searched in Arrow batches, as in ``with_candidates``.
    """
    body = f"`{text}`"
    guard = f"contains({body}, '[')"
    search = pyengine.short_finder([pyengine.Short(0, TOKEN, (r"\[",), ("", TOKEN))])
    df = df.withColumn("__short", search(F.expr(f"if({pyengine.is_short(body)}, {body}, null)")))
    found = let("n", f"length({body})", matching.located(matching.hits(body, TOKEN, 0, guard), "n"))
    found = f"if(__short is null, {found}, __short)"
    spans = f"transform({found}, x -> struct(x.start, x.end, 'token', '', x.value))"
    empty = f"cast(array() as {SPANS})"
    return df.withColumn(out, F.expr(f"if({body} is null, {empty}, cast({spans} as {SPANS}))")).drop("__short")


def restore(
    df: DataFrame, mapping: DataFrame, doc: str, scope: str = "global", text: str = "text", out: str = "restored", stored: bool = False
) -> DataFrame:
    """Replace every known placeholder of the row's scope; unknown ones stay.

    One pass: a restored value is not searched again. The text meets the edits once, by
    ``doc``, which must be unique. ``df`` is needed twice, for its tokens and for its texts, so it is written first
    unless it is ``stored`` already and cheap to read again.
    """
    if not stored:
        df = written(df)
    tokens = (
        with_tokens(df.select(doc, text, *([] if scope in ("global", doc, text) else [scope])), text)
        .select(doc_column(doc).alias("doc"), scope_column(scope).alias("scope"), F.explode(values_of("tokens")).alias("v"))
        .select("doc", "scope", F.col("v.value").alias("placeholder"), "v.at")
    )
    edits = edits_by_lookup(written(tokens), mapping, ["scope", "placeholder"], "value", "doc")
    joined = df.join(edits.withColumnRenamed("doc", doc), doc, "left")
    return apply_edits(joined, text, out)


def expand_nested(mapping: DataFrame) -> DataFrame:
    """A mapping whose values have the placeholders inside them replaced, for ``restore``.

    Restoring entry by entry in order of appearance would replace a placeholder inside a
    restored value when its own entry comes later. This gives the same texts in one pass:
    values with later placeholders in them, few if any, are expanded until none changes.
    """
    order = ["first_seq", "first_back"]
    entries = mapping.withColumn("first_back", -F.col("first_pos"))
    nested = written(entries.where(F.rlike("value", F.lit(TOKEN))).withColumn("expanded", F.col("value")))
    while True:
        inner = entries.select(
            "scope",
            "placeholder",
            F.struct(*order).alias("inner_order"),
            F.col("value").alias("inner_value"),
        )
        done = nested.select("scope", "placeholder", F.col("expanded").alias("inner_expanded"))
        known = inner.join(done, ["scope", "placeholder"], "left").withColumn(
            "replacement", F.coalesce("inner_expanded", "inner_value")
        )
        tokens = with_tokens(nested, "value").select(
            "scope",
            F.col("placeholder").alias("outer"),
            F.struct(*order).alias("outer_order"),
            F.explode(values_of("tokens")).alias("v"),
        )
        later = tokens.select("scope", "outer", "outer_order", F.col("v.value").alias("placeholder"), "v.at").join(
            known.select("scope", "placeholder", "inner_order", "replacement"), ["scope", "placeholder"]
        )
        placed = F.transform("at", lambda s: F.struct(s.start, s.end, F.col("replacement")))
        edits = (
            later.where("inner_order > outer_order")
            .groupBy("scope", F.col("outer").alias("placeholder"))
            .agg(F.array_sort(F.flatten(F.collect_list(placed))).cast(EDITS).alias("edits"))
        )
        before = nested.withColumnRenamed("expanded", "before")
        nested = written(apply_edits(before.join(edits, ["scope", "placeholder"], "left"), "value", "expanded"))
        if nested.where("expanded <> before").isEmpty():
            break
        nested = nested.drop("before")
    expanded = nested.select("scope", "placeholder", "expanded")
    return (
        mapping.join(expanded, ["scope", "placeholder"], "left")
        .withColumn("value", F.coalesce("expanded", "value"))
        .select(mapping.columns)
    )
