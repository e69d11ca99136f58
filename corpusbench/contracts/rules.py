"""One validation operator for every contract: rules in, valid rows and violation rows out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.functions.text import has_text


class Rule(NamedTuple):
    """``holds`` must be true; NULL counts as a violation."""

    name: str
    holds: Column
    message: str


class Validated(NamedTuple):
    valid: DataFrame
    violations: DataFrame


_BROKEN = "_broken_rules"


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Array of (rule, message) a row breaks, in rule order."""
    each = [
        F.when(
            ~F.coalesce(rule.holds, F.lit(False)),
            F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.message).alias("message")),
        )
        for rule in rules
    ]
    return F.filter(F.array(*each), lambda e: e.isNotNull())


def violations(df: DataFrame, rules: Sequence[Rule], key: str | Sequence[str]) -> DataFrame:
    """(key, rule, message), one row per broken rule."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.explode(broken_rules(rules)).alias("e")).select(*keys, "e.rule", "e.message")


def validate(df: DataFrame, rules: Sequence[Rule], key: str | Sequence[str]) -> Validated:
    """Split rows into valid ones and a violation table; no row is dropped unreported."""
    marked = df.withColumn(_BROKEN, broken_rules(rules))
    valid = marked.where(F.size(_BROKEN) == 0).drop(_BROKEN)
    return Validated(valid, violations(df, rules, key))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


# --- conditions the rule sets share ---------------------------------------------------------------


def non_blank(column: Column) -> Column:
    return column.isNotNull() & has_text(column)


def optional(column: Column, holds: Column) -> Column:
    return column.isNull() | holds


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def positive_finite(column: Column) -> Column:
    return finite(column) & (column > 0)


def whole_text(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")
