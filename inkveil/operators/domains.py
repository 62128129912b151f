"""Domain names: splitting on a table of public suffixes, scoring, and finding them in texts.

``suffixes(rule STRING, private BOOLEAN)`` holds public-suffix rules: plain (``co.uk``),
wildcard (``*.ck``) and exception (``!www.ck``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil import catalog
from inkveil.functions import matching
from inkveil.functions.arrays import let
from inkveil.functions.lineage import written
from inkveil.operators.rewrite import looked_up


def _rules(suffixes: DataFrame) -> DataFrame:
    """One row per dotted name that a rule speaks about, whatever kinds of rules do."""
    kind = F.substring("rule", 1, 1)
    named = suffixes.select(
        F.lower(F.regexp_replace("rule", r"^(?:\*\.|!)", "")).alias("name"),
        (kind == "*").alias("wild"),
        (kind == "!").alias("exception"),
        F.coalesce("private", F.lit(False)).alias("private"),
    ).withColumn("plain", ~F.col("wild") & ~F.col("exception"))
    return named.groupBy("name").agg(
        F.struct(
            F.max("plain").alias("plain"),
            F.max("wild").alias("wild"),
            F.max("exception").alias("exception"),
            F.max("private").alias("private"),
        ).alias("rule")
    )


def suffix_starts(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host, suffix_at, is_private``: the label index where the public suffix begins.

    The tails of a host's labels, as many as the longest rule has, are joined with the
    rules; an exception wins, else the longest suffix. A wildcard rule takes one label more
    than its name, an exception one less. ``suffix_at`` is null without a rule. ``hosts``
    holds distinct hosts.
    """
    rules = written(_rules(suffixes))
    longest = rules.agg(F.max(F.size(F.split("name", "[.]")))).first()[0] or 0
    hosts = hosts.withColumn("labels", F.split("host", "[.]"))
    tails = hosts.select(
        "host",
        F.expr(
            f"explode(transform(sequence(greatest(size(labels) - {longest}, 0), size(labels) - 1), "
            "i -> struct(i as at, lower(array_join(slice(labels, i + 1, size(labels)), '.')) as name)))"
        ).alias("t"),
    ).select("host", "t.at", "t.name")
    hits = looked_up(written(tails), rules, ["name"], "rule")

    def place(k: int, at: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), at.alias("at"), F.col("rule.private").alias("private"))

    order = (
        F.when(F.col("rule.exception"), place(0, F.col("at") + 1))
        .when(F.col("rule.wild") & (F.col("at") >= 1), place(1, F.col("at") - 1))
        .when(F.col("rule.plain"), place(1, F.col("at")))
    )
    best = hits.groupBy("host").agg(F.min(order).alias("best"))
    return hosts.join(best, "host", "left").select(
        "host", F.col("best.at").alias("suffix_at"), F.col("best.private").alias("is_private")
    )


def split_domains(df: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Add ``subdomain, domain, suffix, fqdn, is_valid, is_private`` to rows with a host.

    Distinct hosts meet the rules, so a host found everywhere is worked on once. ``df``
    should be narrow: it is written once.
    """
    rows = written(df.withColumn("__host", F.coalesce(host, F.lit(""))))
    hosts = rows.select(F.col("__host").alias("host")).distinct()
    starts = written(suffix_starts(hosts, suffixes)).select(
        F.col("host").alias("__host"), F.struct("suffix_at", "is_private").alias("found")
    )
    labels = "split(__host, '[.]')"
    at = f"coalesce(found.suffix_at, size({labels}))"
    out = looked_up(rows, starts, ["__host"], "found").select(
        *df.columns,
        F.expr(f"array_join(slice({labels}, 1, greatest({at} - 1, 0)), '.')").alias("subdomain"),
        F.expr(f"coalesce(get({labels}, {at} - 1), '')").alias("domain"),
        F.expr(f"array_join(slice({labels}, {at} + 1, size({labels})), '.')").alias("suffix"),
        F.expr("coalesce(found.is_private, false)").alias("is_private"),
    )
    valid = (F.col("domain") != "") & (F.col("suffix") != "")
    return out.withColumn("is_valid", valid).withColumn("fqdn", F.when(valid, F.col(host)).otherwise(F.lit("")))


def confidence() -> Column:
    """Score of a split domain, from its parts."""
    full = (F.col("domain") != "") & (F.col("suffix") != "")
    score = F.lit(0.5) + F.when(full, 0.3).otherwise(0.0)
    score = score + F.when(F.col("subdomain") != "", 0.1).otherwise(0.0)
    last = F.substring_index("suffix", ".", -1)
    score = score + F.when(last.isin(*catalog.COMMON_TLDS), 0.1).otherwise(0.0)
    score = score - F.when(F.length("domain") < 3, 0.2).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def entity() -> Column:
    return (
        F.when(F.col("subdomain") != "", "FQDN")
        .when((F.col("domain") != "") & (F.col("suffix") != ""), "DOMAIN")
        .otherwise("TLD")
    )


def find_domains(
    df: DataFrame, suffixes: DataFrame, doc: str, text: str = "text", threshold: float = catalog.CONFIDENCE_THRESHOLD
) -> DataFrame:
    """Scored findings: dotted names whose domain and public suffix both exist."""
    body = f"`{text}`"
    guard = r"rlike(t, '(?iu)[a-z0-9]\\.[a-z]{2}')"
    found = matching.hits("t", matching.jvm_regex(catalog.NAME_START + catalog.DOMAIN_PATTERN), 1, guard)
    located = let("t", body, let("n", "length(t)", matching.located(found, "n")))
    rows = df.select(doc, F.expr(f"explode({located})").alias("f")).select(
        doc, F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.value").alias("value")
    )
    split = split_domains(rows, suffixes, "value").where("is_valid").withColumn("confidence", confidence())
    return split.where(F.col("confidence") >= threshold).select(
        doc,
        F.col("start").cast("bigint").alias("seq"),
        "start",
        "end",
        "value",
        entity().alias("entity"),
        "confidence",
        F.lit("domains").alias("source"),
        F.lit(None).cast("string").alias("language"),
        F.create_map(
            F.lit("subdomain"), "subdomain", F.lit("domain"), "domain", F.lit("suffix"), "suffix",
            F.lit("fqdn"), "fqdn", F.lit("is_private"), F.col("is_private").cast("string"),
        ).alias("metadata"),
    )
