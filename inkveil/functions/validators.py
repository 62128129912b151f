"""Checks on a matched value, as SQL text, Column expressions and SQL functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession, functions as F

from inkveil.functions.arrays import strings

PHONE = "length(regexp_replace({v}, '[^0-9]', '')) >= 8"
CARD = "length(regexp_replace({v}, '[^0-9]', '')) >= 13 and luhn_check(regexp_replace({v}, '[^0-9]', ''))"
PRESERVED = "exists({kept}, p -> contains(lower({v}), lower(p)))"


def phone_sql(value: str) -> str:
    """At least eight digits."""
    return PHONE.format(v=value)


def card_sql(value: str) -> str:
    """At least thirteen digits that pass the Luhn check."""
    return CARD.format(v=value)


def preserved_sql(value: str, preserve: Sequence[str]) -> str:
    """Any preserved string occurs in the value, ignoring case."""
    return PRESERVED.format(v=value, kept=strings(list(preserve))) if preserve else "false"


def is_phone(column: str) -> Column:
    return F.expr(phone_sql(column))


def is_card(column: str) -> Column:
    return F.expr(card_sql(column))


def is_preserved(column: str, preserve: Sequence[str]) -> Column:
    return F.expr(preserved_sql(column, preserve))


def register_sql(spark: SparkSession) -> None:
    """Make the checks callable from SQL as temporary functions."""
    bodies = {
        "is_phone_value(v STRING)": phone_sql("v"),
        "is_card_value(v STRING)": card_sql("v"),
        "is_preserved_value(v STRING, kept ARRAY<STRING>)": PRESERVED.format(v="v", kept="kept"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS BOOLEAN RETURN {body}")
