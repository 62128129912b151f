"""Preserved strings as a table of any size: values that hold one of them are no findings.

Whether a string occurs in a value can't be hashed, but its pieces can. Every preserved string is looked up by
one anchor: of its pieces of the largest power of two that fits (at most ``LONGEST`` characters), the one that the
fewest preserved strings share. Distinct values are cut into pieces of these lengths, the pieces meet the anchors in
one equality join, and what met is compared in full. Neither side has to fit anywhere, and the plan holds no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.lineage import written
from inkveil.operators.candidates import CANDIDATES
from inkveil.operators.rewrite import fits_broadcast

LONGEST = 32
#: Longer values are cut into parts that overlap, before they are cut into pieces.
PART = 4096


def _pieces(text: str, length: int) -> Column:
    """All distinct pieces of so many characters."""
    if not length:
        return F.array(F.lit(""))
    return F.expr(f"array_distinct(regexp_extract_all(`{text}`, '(?s)(?=(.{{{length}}}))', 1))")


def _cut(rows: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """``key, length, piece`` for the given lengths."""
    parts = rows.select(
        key, F.explode(F.expr(f"transform(sequence(0, greatest(length(`{text}`) - 1, 0), {PART}), i -> substring(`{text}`, i + 1, {PART + LONGEST - 1}))")).alias("part")
    )
    each = F.array(*(F.struct(F.lit(n).alias("length"), _pieces("part", n).alias("of")) for n in lengths))
    return parts.select(key, F.explode(each).alias("g")).select(key, "g.length", F.explode("g.of").alias("piece"))


def anchors(preserved: DataFrame, text: str) -> DataFrame:
    """``p`` (a preserved string in lower case), ``length`` and ``piece``: one row for each; written."""
    size = F.expr("if(length(p) = 0, 0, least(32, shiftleft(1, cast(floor(log2(length(p))) as int))))")
    strings = written(preserved.select(F.lower(F.col(text).cast("string")).alias("p")).where("p is not null").distinct().withColumn("size", size))
    lengths = [r.size for r in strings.select("size").distinct().collect()]
    if not lengths:
        return written(strings.select("p", F.col("size").alias("length"), F.lit("").alias("piece")))
    cut = [_cut(strings.where(F.col("size") == n), "p", "p", [n]) for n in sorted(lengths)]
    pieces = cut[0]
    for more in cut[1:]:
        pieces = pieces.unionByName(more)
    pieces = written(pieces.distinct())
    shared = pieces.groupBy("length", "piece").agg(F.count("*").alias("n"))
    rarest = pieces.join(shared, ["length", "piece"]).groupBy("p").agg(F.min(F.struct("n", "length", "piece")).alias("a"))
    return written(rarest.select("p", "a.length", "a.piece"))


def holding(values: DataFrame, preserved: DataFrame, text: str = "text") -> DataFrame:
    """The distinct ``value``s that hold any preserved string, ignoring case; written."""
    known = anchors(preserved, text)
    lengths = sorted(r.length for r in known.select("length").distinct().collect())
    if not lengths:
        return values.select("value").limit(0)
    numbered = written(values.select("value").where("value is not null").distinct().withColumn("id", F.monotonically_increasing_id()).withColumn("v", F.lower("value")))
    met = _cut(numbered, "id", "v", lengths).join(known, ["length", "piece"]).select("id", "p").distinct()
    found = met.join(numbered, "id").where(F.col("v").contains(F.col("p")))
    return written(found.select("value").distinct())


def without_preserved(found: DataFrame, preserved: DataFrame, text: str = "text", candidates: str = "candidates") -> DataFrame:
    """``found`` without the candidates whose value holds a preserved string.

    Candidates are dropped before overlaps are settled, so what a preserved one covered comes up. ``found`` is
    written, so it should not carry texts.
    """
    rows = written(found.withColumn("__row", F.monotonically_increasing_id()))
    each = rows.select("__row", F.explode(candidates).alias("x")).withColumn("value", F.col("x.value"))
    held = holding(each, preserved, text)
    kept = each.join(F.broadcast(held) if fits_broadcast(held) else held, "value", "left_anti")
    regrouped = kept.groupBy("__row").agg(F.array_sort(F.collect_list("x")).alias("__kept"))
    joined = rows.drop(candidates).join(regrouped, "__row", "left")
    return joined.withColumn(candidates, F.coalesce("__kept", F.expr(f"cast(array() as {CANDIDATES})"))).drop("__row", "__kept")
