"""The mapping table: one placeholder per value within a scope, numbered in reading order.

``mapping(scope, value, placeholder, prefix, n, first_seq, first_pos)``: ``first_seq`` and
``first_pos`` say when the value came up first. Documents count in ``seq`` order; inside a
document the last occurrence counts, and later positions come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from inkveil.functions.arrays import let
from inkveil.functions.lineage import written
from inkveil.operators.numbering import placeholder_sql, values_sql

GLOBAL_SCOPE = ""


def mapping_schema(seq: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("scope", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("placeholder", T.StringType()),
            T.StructField("prefix", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("first_seq", seq),
            T.StructField("first_pos", T.IntegerType()),
        ]
    )


def empty_mapping(spark: SparkSession, seq: T.DataType | None = None) -> DataFrame:
    return spark.createDataFrame([], mapping_schema(seq or T.LongType()))


def scope_column(scope: str) -> Column:
    """``'global'``: one scope for all rows; otherwise the name of the column that holds it.

    Rows without a scope share the empty one: a null would find no mapping and stay unredacted.
    """
    return F.lit(GLOBAL_SCOPE) if scope == "global" else F.coalesce(F.col(scope).cast("string"), F.lit(GLOBAL_SCOPE))


def doc_column(doc: str) -> Column:
    """The document id; a null would find no edits, so it fails."""
    return F.coalesce(F.col(doc), F.raise_error("document id is null"))


def keyed_values(spanned: DataFrame, doc: str, scope: str, seq: str, spans: str = "spans") -> DataFrame:
    """One row per document and distinct value: ``doc, scope, seq, of, value, last, prefix, at``.

    ``of`` is the number of such rows of the document.

    A written narrow table that numbering and rewriting share, so that texts are searched
    once and not carried along.
    """
    counted = F.expr(let("vals", values_sql(f"`{spans}`"), "transform(vals, v -> struct(size(vals) as of, v as v))"))
    rows = spanned.select(
        doc_column(doc).alias("doc"),
        scope_column(scope).alias("scope"),
        F.col(seq).alias("seq"),
        F.explode(counted).alias("e"),
    )
    return written(rows.select("doc", "scope", "seq", "e.of", "e.v.value", "e.v.last", "e.v.prefix", "e.v.at"))


def assign(keyed: DataFrame, existing: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """Mapping entries for the values that ``existing`` does not know yet.

    Known values keep their placeholder; new ones go on from the highest number of their
    prefix, which ``tops`` (``scope, prefix, top``) tells if it is given. Only partial aggregates are shuffled, so a value found everywhere costs one row
    per task.
    """
    first = keyed.groupBy("scope", "value").agg(
        F.min(F.struct("seq", (-F.col("last")).alias("back"), "prefix")).alias("first")
    )
    if existing is not None:
        first = first.join(existing.select("scope", "value"), ["scope", "value"], "left_anti")
    fresh = first.select(
        "scope",
        "value",
        "first.prefix",
        F.col("first.seq").alias("first_seq"),
        (-F.col("first.back")).alias("first_pos"),
    )
    if tops is None and existing is not None:
        tops = existing.groupBy("scope", "prefix").agg(F.max("n").alias("top"))
    return _numbered(fresh, tops)


def _numbered(fresh: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Number rows per scope and prefix by order of appearance, without one task per prefix.

    A global sort splits even a single prefix over many tasks. Row ids ascend inside each
    sorted part, so a number is the row's distance from the part's first id plus the rows
    of the same prefix in earlier parts, of which there are few.
    """
    group = ["scope", "prefix"]
    ordered = written(
        fresh.orderBy("scope", "prefix", "first_seq", F.desc("first_pos"), "value").withColumn(
            "row", F.monotonically_increasing_id()
        )
    ).withColumn("part", F.shiftright("row", 33))
    parts = ordered.groupBy(*group, "part").agg(F.min("row").alias("low"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("low") + 1)
    if tops is not None:
        bases = bases.join(tops, group, "left").withColumn("base", F.col("base") + F.coalesce("top", F.lit(0)))
    return (
        ordered.join(bases.select(*group, "part", "base"), [*group, "part"])
        .withColumn("n", F.col("row") + F.col("base"))
        .select(
            "scope",
            "value",
            F.expr(placeholder_sql("prefix", "n")).alias("placeholder"),
            "prefix",
            "n",
            "first_seq",
            "first_pos",
        )
    )


def counters(mapping: DataFrame) -> DataFrame:
    """Distinct values per scope and prefix."""
    return mapping.groupBy("scope", "prefix").agg(F.count("*").alias("n_values"))


def mapping_pairs(mapping: DataFrame) -> DataFrame:
    """``placeholder, value`` in order of first appearance, scope by scope."""
    return mapping.orderBy("scope", "first_seq", F.desc("first_pos")).select("scope", "placeholder", "value")


def forget(mapping: DataFrame, scopes: list[str]) -> DataFrame:
    """The mapping without the given scopes."""
    return mapping.where(~F.col("scope").isin(scopes))
