"""Operators that keep or drop single entries.

All are narrow: no shuffle, one projection each, fused by Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.values import field_string, field_text, field_type, present
from riverlog.model import FIELD_TYPES, LEVELS, FieldRule, MatchRule, require, require_rules


def filter_fields(df: DataFrame, rules: Sequence[MatchRule]) -> DataFrame:
    """Keep entries that satisfy every rule; a missing field fails its rule."""
    for position, rule in enumerate(rules):
        require(rule.field.strip() != "", f"filter: rule[{position}] has an empty field")
        require(len(rule.values) > 0, f"filter: rule[{position}] has no values")
    for rule in rules:
        accepted = sorted({value.lower() for value in rule.values})
        df = df.where(F.lower(field_text(rule.field)).isin(*accepted))
    return df


def level_rank(level: Column) -> Column:
    """Severity 0-4 of a level name, NULL when unknown."""
    rank = None
    for position, name in enumerate(LEVELS):
        test = level == name
        rank = F.when(test, position) if rank is None else rank.when(test, position)
    return rank


def min_level(df: DataFrame, name: str, case_sensitive: bool = False) -> DataFrame:
    """Keep entries at least as severe as ``name``; unknown levels are dropped."""
    require(name != "", "min_level: the level must not be empty")
    wanted = name if case_sensitive else name.lower()
    require(wanted in LEVELS, f"min_level: unknown level {name!r}; use one of {', '.join(LEVELS)}")
    level = field_string("level")
    if not case_sensitive:
        level = F.lower(level)
    # A plain membership test, so that it can reach a columnar scan.
    return df.where(level.isin(*LEVELS[LEVELS.index(wanted) :]))


def keep_expression(rate: float, seed: int | None = None, key: str | Column | None = None) -> Column:
    """True for a sampled entry.

    With ``key`` the decision is a hash of key and seed: equal keys share one
    fate, in any engine, at any parallelism, after any task retry.  Without a
    key it is a random draw.
    """
    require(0 < rate <= 1, f"sample: the rate must be above 0 and at most 1, got {rate}")
    if rate == 1:
        return F.lit(True)
    if key is None:
        return (F.rand() if seed is None else F.rand(seed)) < rate
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(column.cast("string"), F.lit("" if seed is None else str(seed))))
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return head / F.lit(float(2**32)) < rate


def sample_logs(
    df: DataFrame, rate: float, seed: int | None = None, key: str | Column | None = None
) -> DataFrame:
    return df.where(keep_expression(rate, seed, key))


def sample_stats(
    df: DataFrame, rate: float, seed: int | None = None, key: str | Column | None = None
) -> DataFrame:
    """One row: how many entries a sample keeps and drops."""
    marked = df.select(keep_expression(rate, seed, key).alias("keep"))
    return marked.agg(
        F.count_if(F.coalesce("keep", F.lit(False))).alias("kept"),
        F.count_if(~F.coalesce("keep", F.lit(False))).alias("dropped"),
    )


def violation(rules: Sequence[FieldRule]) -> Column:
    """Text of the first broken rule, NULL for a valid entry."""
    require_rules("validate", rules)
    for position, rule in enumerate(rules):
        require(rule.name != "", f"validate: rule[{position}] has an empty name")
    found = []
    for rule in rules:
        kind = field_type(rule.name)
        broken = None
        if rule.required:
            broken = F.when(~present(rule.name), F.lit(f"required field {rule.name} is missing"))
        if rule.type in FIELD_TYPES:
            mismatch = kind != rule.type
            text = F.concat(F.lit(f"field {rule.name} must be a {rule.type}, got "), kind)
            broken = F.when(mismatch, text) if broken is None else broken.when(mismatch, text)
        if broken is not None:
            found.append(broken)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def valid_entries(df: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    return df.where(violation(rules).isNull())


def schema_violations(df: DataFrame, rules: Sequence[FieldRule]) -> DataFrame:
    return df.withColumn("violation", violation(rules)).where(F.col("violation").isNotNull())


def validate(df: DataFrame, rules: Sequence[FieldRule]) -> tuple[DataFrame, DataFrame]:
    """``(valid, invalid)``; invalid entries carry the first ``violation``.  Two
    plans over the entries, also of a stream: to use both of a table, add
    ``violation`` to it, write it once and filter that."""
    return valid_entries(df, rules), schema_violations(df, rules)
