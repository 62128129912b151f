"""SQL functions: checks, findings of a text, redaction of a text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkveil import catalog
from inkveil.config import Config
from inkveil.functions import validators
from inkveil.functions.arrays import let, strings
from inkveil.operators.candidates import candidates_sql
from inkveil.operators.numbering import EDITS, document_edits_sql
from inkveil.operators.resolve import SPANS, spans_sql
from inkveil.operators.rewrite import spliced_sql


def register(spark: SparkSession, config: Config | None = None, suffix: str = "") -> None:
    """Register, under names that end in ``suffix``:

    ``sensitive_findings(text)`` - array of findings, to be exploded in an outer query;
    ``findings_of(text, kinds)`` - a table function, for ``LATERAL``: a row per finding of the given types (an array
    of names; left out or null: all of ``config``); a literal array takes the other types out of the plan;
    ``redact_text(text)`` - the text with document-scope placeholders;
    ``is_phone_value``, ``is_card_value``, ``is_preserved_value``.
    """
    config = config or Config()
    validators.register_sql(spark)
    find, number = f"sensitive_findings{suffix}", f"finding_edits{suffix}"
    bodies = {
        f"{find}(x STRING) RETURNS {SPANS}": let("c", candidates_sql("x", config), spans_sql("c")),
        f"{number}(s {SPANS}) RETURNS {EDITS}": document_edits_sql("s"),
        f"spliced_text{suffix}(x STRING, ed {EDITS}) RETURNS STRING": spliced_sql("x", "ed"),
        f"redact_text{suffix}(x STRING) RETURNS STRING": f"spliced_text{suffix}(x, {number}({find}(x)))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    every = strings([*sorted(config.types), catalog.CUSTOM])
    chosen = let("c", candidates_sql("x", config, f"coalesce(kinds, {every})"), spans_sql("c"))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION findings_of{suffix}(x STRING, kinds ARRAY<STRING> DEFAULT NULL) "
        "RETURNS TABLE(type STRING, value STRING, start INT, `end` INT, prefix STRING) "
        f"RETURN SELECT f.type, f.value, f.start, f.`end`, f.prefix FROM (SELECT explode({chosen}) AS f)"
    )
