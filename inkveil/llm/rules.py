"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Counts per text are array expressions within the row. A rule rejects a document whose measure is
above the rule's cutoff. Each rule has a fixed list of cutoffs, from mild to strict, spread over ``STEPS`` steps, and all
rules move along together: step j sets every rule's j-th cutoff. A step is safe in a stratum if the exact
binomial test, on labelled good documents, refutes that the rules at that step reject more than ``ALPHA`` of the stratum's
good documents. Steps are tested in sequence, up to the first that isn't safe, which needs no correction; nor do the rules, since a step
is tested as a whole. Strata are corrected for, by the level ``DELTA`` over their number (Bonferroni). So with
probability 1 - ``DELTA``, in every stratum at once, the rules reject at most ``ALPHA`` of the good documents that pass the base rule.

A stratum with fewer good documents than the test needs at the least, even without a single rejection, can't have a safe step of its
own. All such strata are tested as one joint stratum, and the guarantee then holds for what they hold together. Copies of a
text count once as evidence.

Defined results: null and empty texts have no words and fail the base rule. Null strata are a
stratum of their own, strata without labels have no rules, a document with several labels is good if
all of them say so, and labels without a document or a value count nothing. Rows are documents;
repeated or null ids stay. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.arrays import indexes, let
from inkveil.functions.lineage import written

ALPHA = 0.02
DELTA = 0.05
MIN_WORDS = 50
STEPS = 18

#: Per rule: the measure, and its cutoffs from mild to strict.
RULES = {
    "symbols": ("n_symbols / n_words", (4, 3, 2.5, 2, 1.5, 1.2, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "capitals": ("n_upper / greatest(word_chars, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "long_words": ("word_chars / n_words", (30, 20, 16, 14, 12, 11, 10, 9.5, 9, 8.5, 8, 7.5, 7)),
    "short_words": ("n_words / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35)),
}


def _repeat_words() -> str:
    """Words of ``w`` in 3-word windows that occur more than once.

    Windows are sorted by hash, so equal ones are neighbours; their places, sorted, each add the
    words that the place before did not cover. A text without repeats skips that.
    """
    hashes = f"transform({indexes('0', 'size(w) - 3')}, i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    ordered = "sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))"
    pairs = "zip_with(slice(o, 1, size(o) - 1), slice(o, 2, size(o) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>)))"
    places = f"sort_array(array_distinct(flatten({pairs})))"
    covered = (
        f"aggregate({places}, named_struct('n', 0L, 'last', -3), "
        "(a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"
    )
    return let("hs", hashes, f"if(size(array_distinct(hs)) = size(hs), 0L, {let('o', ordered, covered)})")


def counts(text: str) -> Column:
    """A struct of all counts of a whole text; ``text`` is a SQL expression."""
    lines = f"filter(split(t, '\\n', -1), l -> l rlike r'[^\\x20\\x09-\\x0D]')"
    fields = {
        "n_words": "size(w)",
        "word_chars": "length(array_join(w, ''))",
        "n_symbols": "length(regexp_replace(t, r'[^#*$%&|<>]+', ''))",
        "n_upper": r"length(regexp_replace(t, r'[^\p{Lu}]+', ''))",
        "n_lines": "size(l)",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": _repeat_words(),
    }
    body = "named_struct(" + ", ".join(f"'{k}', cast({v} as bigint)" for k, v in fields.items()) + ")"
    words = r"array_remove(split(t, r'[\x20\x09-\x0D]+', -1), '')"
    return F.expr(let("t", f"coalesce({text}, '')", let("w", words, let("l", lines, body))))


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One narrow written row per document with its counts; texts are read once."""
    whole = F.col(text).cast("string")
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), whole.alias("__text"), F.xxhash64(whole).alias("content"))
    counted = rows.select("doc_id", "stratum", "content", counts("__text").alias("c")).select("doc_id", "stratum", "content", "c.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return written(counted.withColumn("base_failed", failed))


def binomial_cdf(k: str, n: str, p: float) -> str:
    """P(X <= k) of a binomial X, 1 where ``k`` is at or above the mean (no test passes there).

    Terms are taken relative to the last one, whose logarithm is summed, so nothing underflows.
    """
    step = (
        f"named_struct('log', a.log + ln(({n} - j + 1) / cast(j as double)), "
        f"'sum', 1D + a.sum * (j * {1 - p!r}D) / (({n} - j + 1) * {p!r}D))"
    )
    last = f"a.log + {k} * ln({p!r}D) + ({n} - {k}) * ln({1 - p!r}D) + ln(a.sum)"
    fold = f"aggregate({_upto(k)}, named_struct('log', 0D, 'sum', 1D), (a, j) -> {step}, a -> exp({last}))"
    return f"if({k} >= {n} * {p!r}D, 1D, {fold})"


def _upto(k: str) -> str:
    return f"if({k} >= 1, sequence(1L, {k}), cast(array() as array<bigint>))"


def path(rule: str) -> list[float]:
    """The rule's cutoff at every step."""
    cuts = RULES[rule][1]
    return [float(cuts[j * len(cuts) // STEPS]) for j in range(STEPS)]


def strictness() -> Column:
    """How many steps reject the document; as cutoffs fall, it is the strictest ones. Null where the base rule has failed."""
    each = (f"size(filter(array({', '.join(f'{c!r}D' for c in path(rule))}), c -> {measure} > c))" for rule, (measure, _) in RULES.items())
    return F.expr(f"if(base_failed, null, greatest({', '.join(each)}))")


def least(strata: int) -> int:
    """Good documents without which no step can be safe."""
    return math.ceil(math.log(DELTA / max(1, strata)) / math.log(1 - ALPHA))


def steps(rows: DataFrame, labels: DataFrame, doc: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Per stratum with labels: ``n`` good documents of the test, whether it was ``joint``, the ``step`` (from 0, null: none is safe) and its ``rejected``."""
    good = labels.groupBy(F.col(doc).alias("doc_id")).agg(F.min(quality).alias("q")).where("q = 1").select("doc_id")
    evidence = rows.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "content"])
    seen = written(evidence.groupBy("stratum", strictness().alias("strict")).count())
    sizes = seen.groupBy("stratum").agg(F.sum("count").alias("own"))
    strata = sizes.count()
    tested = written(sizes.withColumn("joint", F.col("own") < least(strata)).withColumn("g", F.when(~F.col("joint"), F.col("stratum"))))
    names = tested.select(F.col("stratum").alias("s"), "joint", "g")
    pooled = seen.join(names, F.col("stratum").eqNullSafe(F.col("s"))).groupBy("joint", "g").agg(F.sum("count").alias("n"), F.collect_list(F.struct("strict", "count")).alias("c"))
    k = f"transform(sequence(0, {STEPS - 1}), j -> aggregate(filter(c, y -> y.strict >= {STEPS} - j), 0L, (a, y) -> a + y.count))"
    safe = f"transform(k, x -> {binomial_cdf('x', 'n', ALPHA)} <= {DELTA / max(1, strata)!r}D)"
    upto = "if(array_position(safe, false) = 0, size(safe), cast(array_position(safe, false) as int) - 1) - 1"
    found = pooled.withColumn("k", F.expr(k)).withColumn("safe", F.expr(safe)).withColumn("upto", F.expr(upto))
    found = written(found.select(F.col("joint").alias("j2"), F.col("g").alias("g2"), "n", F.expr("if(upto >= 0, upto, null)").alias("step"), F.expr("get(k, upto)").alias("rejected")))
    joined = tested.join(found, (F.col("joint") == F.col("j2")) & F.col("g").eqNullSafe(F.col("g2")))
    return joined.select("stratum", "n", "joint", "step", "rejected")


def judged(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Per document: its counts, whether it fails the base rule, and whether it is kept."""
    rows = measured(docs, doc, text, stratum)
    on = steps(rows, labels).where("step is not null").select(F.col("stratum").alias("s"), "step")
    verdict = rows.withColumn("strict", strictness()).join(on, F.col("stratum").eqNullSafe(F.col("s")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("strict") < STEPS - F.col("step"), F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return verdict.select(F.col("doc_id").alias(doc), *names, kept.alias("kept"))
