"""Line dedup by the spread of a line over sites.

Every line (white space folded, at least ``MIN_CHARS`` characters) has a hash; a HyperLogLog sketch of
the sites it occurs on is built per hash, partly in every task, and the parts are merged. Lines whose
estimate is near the threshold, within ``BAND`` of it, are counted exactly; the others are decided by their
estimate. Lines on ``SITES`` or more sites are cross-site boilerplate and are removed from all documents.

Texts are read twice (hashing, removal) and the lines' table is narrow. A line in a third of all
documents is one sketch per task. For the removal each document's boilerplate lines are gathered by id and text hash,
so there are no more of them than lines of one text, however many documents share an id (or have none). Boilerplate
hashes are broadcast only after they were counted.

Defined results: a null text stays null, with no lines; empty texts stay. Null sites are no site. Lines
that are too short or blank stay where they are, so does the order of the lines. Other columns
are kept by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.lineage import written

SITES = 10
MIN_CHARS = 20
SKETCH = 12
#: More than three standard errors of a sketch of 2^12 registers.
BAND = 0.06
BROADCAST_ROWS = 200_000


def _hash(line: Column) -> Column:
    folded = F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(folded) >= MIN_CHARS, F.xxhash64(folded))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text), ``site``, ``h`` of the distinct lines of every row, written."""
    whole = F.xxhash64(F.col(text).cast("string")).alias("content")
    hashes = F.array_distinct(F.filter(F.transform(_lines(F.col(text).cast("string")), _hash), lambda h: h.isNotNull()))
    return written(docs.select(F.col(doc).alias("doc_id"), whole, F.col(site).cast("string").alias("site"), F.explode(hashes).alias("h")))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """``h`` of the lines on ``sites`` or more sites, written."""
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(SKETCH)).alias("s"))
    estimate = written(sketched.select("h", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= sites * (1 - BAND) - 1))
    sure = estimate.where(F.col("n") > sites * (1 + BAND) + 1).select("h")
    near = estimate.where(F.col("n") <= sites * (1 + BAND) + 1).select("h")
    exact = _among(lines, near).select("h", "site").dropna().distinct().groupBy("h").count().where(F.col("count") >= sites).select("h")
    return written(sure.unionByName(exact))


def _among(lines: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose ``h`` is in ``some`` (distinct), which is broadcast if it is small."""
    return lines.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "h")


def cleaned(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, out: str = "text", removed: str = "n_removed"
) -> DataFrame:
    """All columns, with ``out`` (the text without boilerplate lines) and ``removed``, the number of lines."""
    lines = occurrences(docs, doc, text, site)
    wide = _among(lines, boilerplate(lines, sites))
    drops = written(wide.groupBy("doc_id", "content").agg(F.collect_set("h").alias("drop")).toDF("d", "c", "drop"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("whole"))
    # A merge join at any size: the number of documents with boilerplate grows with the corpus.
    found = rows.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("whole") == F.col("c")), "left")
    # Looked up in the document's own few hashes.
    kept = F.filter(_lines(F.col("whole")), lambda x: ~F.coalesce(F.array_contains("drop", _hash(x)), F.lit(False)))
    done = found.withColumn("kept", F.when(F.col("drop").isNotNull(), kept))
    gone = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("whole"))) - F.size("kept")).cast("bigint")
    clean = F.when(F.col("drop").isNull(), F.col("whole")).otherwise(F.array_join("kept", "\n"))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (out, removed)]
    return done.select(*others, clean.alias(out), gone.alias(removed))
