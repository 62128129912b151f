"""Splicing replacements into texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.arrays import CHUNK, chunks, let, slice_chunks
from inkveil.functions.lineage import written
from inkveil.operators.numbering import EDITS

# A value that holds more than one in this many rows is joined by broadcast.
HOT_SHARE = 1000
SALTS = 64
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def spliced_sql(text: str, edits: str, between: str = "{part}", replacement: str = "e.replacement") -> str:
    """The text with every edit made; ``between`` renders the parts that stay.

    Edits are disjoint and ordered. The text is cut into chunks first, so each part costs
    its own length and not its distance from the start. A text of one chunk is sliced as it is.
    """
    end = "if(i = 0, 0, edits[i - 1].end)"

    def made(before: str, rest: str) -> str:
        each = f"concat({between.replace('{part}', before)}, {replacement})"
        return f"concat(array_join(transform(edits, (e, i) -> {each}), ''), {between.replace('{part}', rest)})"

    whole = made(f"substring(body, {end} + 1, e.start - {end})", "substring(body, element_at(edits, -1).end + 1)")
    cut = made(slice_chunks("parts", end, "e.start"), slice_chunks("parts", "element_at(edits, -1).end", f"length({text})"))
    body = f"if(length({text}) <= {CHUNK}, {let('body', text, whole)}, {let('parts', chunks(text), cut)})"
    done = let("edits", edits, body)
    plain = between.replace("{part}", text)
    return f"if(coalesce(size({edits}), 0) = 0, {plain}, {done})"


def spliced(text: str, edits: str) -> Column:
    return F.expr(spliced_sql(f"`{text}`", f"`{edits}`"))


def apply_edits(df: DataFrame, text: str = "text", out: str = "redacted", edits: str = "edits") -> DataFrame:
    return df.withColumn(out, spliced(text, edits)).drop(edits)


def fits_broadcast(table: DataFrame) -> bool:
    """Measure a table: at most 32 MB of text and a million rows."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in table.dtypes if kind == "string"]
    rows, size = table.agg(F.count("*"), F.sum(sum(texts, F.lit(0)))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def looked_up(keys: DataFrame, table: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows of ``keys`` with a match in ``table``, which is unique on ``on``, plus its ``value``.

    Both should be written tables: they are measured first. A table that fits is broadcast.
    Otherwise keys that hold more than a thousandth of all rows (so fewer than a thousand
    keys) are taken apart, by broadcast or, should their texts be too large for it, by a
    salted join; the rest is shuffled. No task meets all rows of a hot key.
    """
    known = table.select(*on, value)
    if fits_broadcast(known):
        return keys.join(F.broadcast(known), on, "inner")
    total = keys.count()
    hot = keys.groupBy(*on).count().where(F.col("count") * HOT_SHARE > F.lit(total)).drop("count")
    hot_known = written(known.join(hot, on, "left_semi")).withColumn("__hot", F.lit(True))
    if fits_broadcast(hot_known):
        marked = keys.join(F.broadcast(hot_known), on, "left")
    else:
        salted = hot_known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = keys.withColumn("__salt", F.pmod(F.xxhash64(*keys.columns), F.lit(SALTS)).cast("int"))
        marked = spread.join(salted.hint("merge"), [*on, "__salt"], "left").drop("__salt")
    common = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot is null").drop("__hot", value).join(known.hint("merge"), on, "inner")
    return common.unionByName(rest)


def edits_by_lookup(
    keys: DataFrame, table: DataFrame, on: list[str], replacement: str, doc: str, of: str | None = None
) -> DataFrame:
    """Edits per document: each row of ``keys`` is a key of a document with its positions ``at``.

    Keys without a replacement yield no edit. ``of`` names a column with the number of keys
    of the document; another number of rows means that two documents share an id, and fails.
    """
    placed = F.transform("at", lambda s: F.struct(s.start, s.end, F.col(replacement)))
    edits = F.array_sort(F.flatten(F.collect_list(placed))).cast(EDITS)
    if of is not None:
        message = F.concat(F.lit("document id is not unique: "), F.col(doc).cast("string"))
        same = (F.count("*") == F.max(of)) & (F.max(of) == F.min(of))
        edits = F.when(same, edits).otherwise(F.raise_error(message).cast(EDITS))
    return looked_up(keys, table, on, replacement).groupBy(doc).agg(edits.alias("edits"))
