"""Findings of outside recognisers: spans with an entity name and a confidence.

``scored(doc, seq, start, end, value, entity, confidence, source, language)``; ``seq`` is
the order in which a recogniser reported them. They rank before all patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil import catalog
from inkveil.functions import matching
from inkveil.functions.arrays import let, quote, strings
from inkveil.operators.candidates import CANDIDATES

SCORED_COLUMNS = ("seq", "start", "end", "value", "entity", "confidence", "source", "language")


def type_of(entity: str) -> Column:
    """The type an entity name stands for; ``custom`` when unknown. Case does not matter."""
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in catalog.ENTITY_TYPES.items())
    return F.expr(f"coalesce(try_element_at(map({pairs}), upper(`{entity}`)), {quote(catalog.CUSTOM)})")


def above(scored: DataFrame, threshold: float = catalog.CONFIDENCE_THRESHOLD) -> DataFrame:
    return scored.where(F.col("confidence") >= threshold)


def best_per_span(scored: DataFrame, doc: str) -> DataFrame:
    """One finding per span: the most confident, the earliest on ties, in the span's first place."""
    rest = [c for c in scored.columns if c not in (doc, "start", "end", "seq")]
    rank = F.struct("confidence", (-F.col("seq")).alias("back"))
    return (
        scored.groupBy(doc, "start", "end")
        .agg(F.max_by(F.struct(*rest), rank).alias("kept"), F.min("seq").alias("seq"))
        .select(doc, "seq", "start", "end", "kept.*")
    )


def merge_scored(docs: DataFrame, scored: DataFrame, doc: str, out: str = "scored", text: str = "text") -> DataFrame:
    """Attach the scored findings of each document as an array for ``with_candidates``.

    Sources are told apart by an integer column ``source_rank`` if there is one: those of a lower rank come first,
    whatever their ``seq``. Spans without extent go here already, so they are not shuffled. Spans that reach
    beyond the text are left out; ``outside_text`` lists them.
    """
    if "source_rank" in scored.columns:
        scored = scored.withColumn("seq", F.col("source_rank").cast("bigint") * F.lit(1 << 50) + F.col("seq"))
    prefixes = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in catalog.PREFIXES.items())
    typed = (
        scored.where((F.col("start") >= 0) & (F.col("end") > F.col("start")))
        .withColumn("type", type_of("entity"))
        .withColumn("prefix", F.expr(f"map({prefixes})[type]"))
    )
    row = F.struct(
        F.lit(0).alias("ord"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        "type",
        "prefix",
        "value",
    )
    arrays = typed.groupBy(doc).agg(F.array_sort(F.collect_list(row)).cast(CANDIDATES).alias(out))
    joined = docs.join(arrays, doc, "left")
    return joined.withColumn(out, F.filter(out, lambda x: x.end <= F.length(text))) if text in docs.columns else joined


def outside_text(docs: DataFrame, scored: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """The scored findings that ``merge_scored`` leaves out: empty, negative or beyond the text."""
    lengths = docs.select(doc, F.length(text).alias("__n"))
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("__n"))
    return scored.join(lengths, doc).where(bad).drop("__n")


def recognise(
    df: DataFrame,
    doc: str,
    text: str = "text",
    languages: Sequence[str] = catalog.DEFAULT_LANGUAGES,
    threshold: float = catalog.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Scored findings of the built-in pattern recognisers, once per configured language.

    A recogniser below the threshold is not run at all. Spans found more than once are
    reduced to the best.
    """
    known = (
        ("FR_SSN", catalog.FR_SSN_PATTERN, 0.85, "fr"),
        ("PHONE_NUMBER", catalog.FR_PHONE_PATTERN, 0.75, "fr"),
        ("DOMAIN_NAME", catalog.NAME_START + catalog.DOMAIN_PATTERN, 0.60, "en"),
    )
    active = [
        (entity, pattern, score, lang)
        for lang in languages
        for entity, pattern, score, of in known
        if of == lang and score >= threshold
    ]
    schema = "array<struct<ord:int,start:int,end:int,value:string>>"
    if active:
        found = [matching.hits("t", matching.jvm_regex(p), i) for i, (_, p, _, _) in enumerate(active, start=1)]
        located = let("n", "length(t)", matching.located(f"concat({', '.join(found)})", "n"))
        value = let("t", f"`{text}`", located)
    else:
        value = f"cast(array() as {schema})"
    names = strings([entity for entity, *_ in active] or [""])
    langs = strings([lang for *_, lang in active] or [""])
    scores = "array(" + ", ".join(f"{score}D" for _, _, score, _ in active or [("", "", 0.0, "")]) + ")"
    rows = df.select(doc, F.expr(f"explode({value})").alias("f")).select(
        doc,
        # Reports come language by language, each in reading order.
        (F.col("f.ord") * F.lit(1 << 40) + F.col("f.start")).alias("seq"),
        F.col("f.start").alias("start"),
        F.col("f.end").alias("end"),
        F.col("f.value").alias("value"),
        F.expr(f"element_at({names}, f.ord)").alias("entity"),
        F.expr(f"element_at({scores}, f.ord)").alias("confidence"),
        F.lit("patterns").alias("source"),
        F.expr(f"element_at({langs}, f.ord)").alias("language"),
    )
    return best_per_span(rows, doc).select(doc, *SCORED_COLUMNS)


def risk_scan(
    docs: DataFrame, found: DataFrame, keys: Sequence[str], threshold: float = catalog.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Per key: highest personal-data and secret confidence, and whether both stay below the threshold.

    ``found`` is a findings table; without a ``confidence`` column each finding counts as
    certain. Keys without findings are safe. One grouping, no join.
    """
    secret = F.col("type").isin(*catalog.SECRET_TYPES)
    confidence = F.col("confidence") if "confidence" in found.columns else F.lit(1.0)
    none = F.lit(0.0)
    rows = docs.select(*keys, none.alias("pii"), none.alias("secret")).unionByName(
        found.select(
            *keys,
            F.when(secret, none).otherwise(confidence).alias("pii"),
            F.when(secret, confidence).otherwise(none).alias("secret"),
        )
    )
    risks = rows.groupBy(*keys).agg(F.max("pii").alias("pii_risk"), F.max("secret").alias("secrets_risk"))
    unsafe_pii, unsafe_secret = F.col("pii_risk") >= threshold, F.col("secrets_risk") >= threshold
    return risks.select(
        *keys,
        (~unsafe_pii).alias("pii_safe"),
        "pii_risk",
        (~unsafe_secret).alias("secrets_safe"),
        "secrets_risk",
        (~unsafe_pii & ~unsafe_secret).alias("is_safe"),
        F.greatest(
            F.when(unsafe_pii, F.col("pii_risk")).otherwise(none),
            F.when(unsafe_secret, F.col("secrets_risk")).otherwise(none),
        ).alias("risk_score"),
    )
