"""Joining of continuation lines (stack traces) to the entry before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.values import field_string, in_fields, put, to_variant
from riverlog.model import FIELDS, TEXT_ATTRIBUTES, require
from riverlog.plans.ordered import RunningMax, with_running


def line_text(field: str) -> Column:
    """The value that is joined; an absent or non-string value is empty text."""
    return F.coalesce(field_string(field), F.lit(""))


def is_continuation(text: Column, prefixes: Sequence[str]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | text.startswith(prefix)
    return test


def check_multiline(field: str, prefixes: Sequence[str]) -> None:
    require(field != "", "multiline: the field must not be empty")
    require(len(prefixes) > 0, "multiline: at least one continuation prefix is required")


def coalesce_multiline(
    df: DataFrame,
    field: str,
    prefixes: Sequence[str],
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    chunks: int | None = None,
) -> DataFrame:
    """Merge each run of entries whose ``field`` starts with a prefix into the
    entry before it; values are joined by line breaks, everything else comes
    from the first entry of the group.

    The group of a row is the place of the last head at or before it: a running
    maximum, found without gathering a source in one task.  Only the lines of
    one record meet in one group, as they must to be one value.  Lines before
    the first head of a source form a group of their own.
    """
    check_multiline(field, prefixes)
    at = F.struct(*order)
    marked = df.withColumn("_text", line_text(field)).withColumn(
        "_head_at", F.when(~is_continuation(F.col("_text"), prefixes), at)
    )
    grouped = with_running(marked, by, order, [RunningMax("_group", F.col("_head_at"))], chunks)
    merged = grouped.groupBy(*by, "_group").agg(
        F.min_by(F.struct(*df.columns), at).alias("_first"),
        F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("_text").alias("text")))).alias(
            "_lines"
        ),
    )
    joined = merged.select(
        "_first.*",
        F.array_join(F.transform("_lines", lambda line: line["text"]), "\n").alias("_joined"),
    )
    return set_text(joined, field, F.col("_joined")).drop("_joined")


def set_text(df: DataFrame, field: str, text: Column) -> DataFrame:
    """Store a text where a look-up of ``field`` finds it."""
    inside = put(F.col(FIELDS), field, to_variant(text))
    if field not in TEXT_ATTRIBUTES:
        return df.withColumn(FIELDS, inside)
    return df.withColumns(
        {
            field: F.when(in_fields(field), F.col(field)).otherwise(text),
            FIELDS: F.when(in_fields(field), inside).otherwise(F.col(FIELDS)),
        }
    )
