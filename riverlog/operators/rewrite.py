"""Operators that rewrite single entries.  All narrow, all built-in expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.text import ELLIPSIS, truncate_bytes
from riverlog.functions.timestamps import parse_rfc3339, rfc3339
from riverlog.functions.values import (
    attribute_text,
    drop_keys,
    in_fields,
    present,
    put,
    to_variant,
    variant_string,
)
from riverlog.model import (
    ATTRIBUTES,
    DEFAULT_MASK,
    FIELDS,
    TEXT_ATTRIBUTES,
    RedactRule,
    RenameRule,
    check_pattern,
    require,
    require_rules,
)

Operator = Callable[[DataFrame], DataFrame]


# -- simple operators -------------------------------------------------------


def add_field(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    """Set ``fields[name]`` to a text value, replacing an older one."""
    text = F.lit(value) if isinstance(value, str) else value
    return df.withColumn(FIELDS, put(F.col(FIELDS), name, to_variant(text)))


def remove_field(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(FIELDS, drop_keys(F.col(FIELDS), [name]))


def normalise_level(df: DataFrame) -> DataFrame:
    return df.withColumn("level", F.upper("level"))


def mask_field(df: DataFrame, name: str, mask: str = DEFAULT_MASK) -> DataFrame:
    """Replace the value of ``name`` when the key exists, whatever its value."""
    masked = F.transform_values(
        FIELDS, lambda key, value: F.when(key == name, to_variant(F.lit(mask))).otherwise(value)
    )
    return df.withColumn(FIELDS, masked)


def apply_all(df: DataFrame, operators: Sequence[Operator]) -> DataFrame:
    """Run operators left to right, each on the result of the one before."""
    return functools.reduce(lambda current, operator: current.transform(operator), operators, df)


# -- string rewrites on looked-up values ------------------------------------


def _rewrite(df: DataFrame, rewrites: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply ``name -> (variant -> variant)`` wherever a look-up finds ``name``."""

    def in_map(key: Column, value: Column) -> Column:
        chosen = None
        for name, rewrite in rewrites.items():
            new = rewrite(value)
            chosen = F.when(key == name, new) if chosen is None else chosen.when(key == name, new)
        return chosen.otherwise(value)

    columns = {FIELDS: F.transform_values(FIELDS, in_map)}
    for name in TEXT_ATTRIBUTES:
        if name in rewrites:
            new = variant_string(rewrites[name](to_variant(F.col(name))))
            shown = ~in_fields(name) & (F.col(name) != "")
            columns[name] = F.when(shown, new).otherwise(F.col(name))
    return df.withColumns(columns)


def redact(df: DataFrame, rules: Sequence[RedactRule], mask: str = DEFAULT_MASK) -> DataFrame:
    """Mask sensitive values, rule after rule.

    A rule without a pattern always masks; with one it masks string values in
    which the pattern is found anywhere.  Absent fields stay absent.
    """
    require_rules("redact", rules)
    for position, rule in enumerate(rules):
        require(rule.field != "", f"redact: rule[{position}] has an empty field")
        if rule.pattern is not None:
            check_pattern(rule.pattern)

    def masking(rule: RedactRule) -> Callable[[Column], Column]:
        hidden = to_variant(F.lit(rule.mask or mask or DEFAULT_MASK))
        if rule.pattern is None:
            return lambda value: hidden
        return lambda value: F.when(variant_string(value).rlike(rule.pattern), hidden).otherwise(value)

    # Rules on different fields share one pass over the map; a second rule on
    # the same field must see what the first one left.
    passes: list[dict[str, Callable[[Column], Column]]] = []
    for rule in rules:
        slot = next((group for group in passes if rule.field not in group), None)
        if slot is None:
            slot = {}
            passes.append(slot)
        slot[rule.field] = masking(rule)
    for group in passes:
        df = _rewrite(df, group)
    return df


def truncate(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Cut string values longer than their byte limit, ending them in an ellipsis."""
    require_rules("truncate", limits)
    for name, limit in limits.items():
        require(name != "", "truncate: a field name is empty")
        require(limit > len(ELLIPSIS), f"truncate: the limit of {name!r} must be above {len(ELLIPSIS)}")

    def cutting(limit: int) -> Callable[[Column], Column]:
        def cut(value: Column) -> Column:
            text = variant_string(value)
            return F.when(F.octet_length(text) > limit, to_variant(truncate_bytes(text, limit))).otherwise(
                value
            )

        return cut

    return _rewrite(df, {name: cutting(limit) for name, limit in limits.items()})


# -- rename -----------------------------------------------------------------


def rename_fields(df: DataFrame, rules: Sequence[RenameRule]) -> DataFrame:
    """Rename keys in one pass over the entry as it was, so that swaps work.

    A renamed value replaces one already under its new name.  Of two rules with
    the same source, or two present sources with the same target, the last rule
    counts.  Attribute columns take part: renaming ``level`` empties the column,
    renaming to ``message`` fills it when the value is a string.
    """
    require_rules("rename", rules)
    for position, rule in enumerate(rules):
        require(rule.source != "", f"rename: rule[{position}] has an empty source")
        require(rule.target != "", f"rename: rule[{position}] has an empty target")
    target_of: dict[str, str] = {}
    for rule in rules:
        target_of.pop(rule.source, None)
        target_of[rule.source] = rule.target

    def value_of(name: str) -> Column:
        inner = F.col(FIELDS).getItem(name)
        if name in ATTRIBUTES:
            return F.when(in_fields(name), inner).otherwise(to_variant(attribute_text(name)))
        return inner

    winners: dict[str, Column] = {}
    arrives: dict[str, Column] = {}
    for source, target in target_of.items():
        if target in winners:
            winners[target] = F.when(present(source), value_of(source)).otherwise(winners[target])
            arrives[target] = arrives[target] | present(source)
        else:
            winners[target] = F.when(present(source), value_of(source))
            arrives[target] = present(source)

    def fits_column(target: str) -> Column:
        text = variant_string(winners[target])
        return (parse_rfc3339(text) if target == "timestamp" else text).isNotNull()

    columns: dict[str, Column] = {}
    for name in ATTRIBUTES:
        vacated = F.lit(None).cast("timestamp") if name == "timestamp" else F.lit("")
        column = F.col(name)
        if name in target_of:
            column = F.when(in_fields(name), column).otherwise(vacated)
        if name in winners:
            text = variant_string(winners[name])
            new = parse_rfc3339(text) if name == "timestamp" else text
            kept = F.when(arrives[name], vacated).otherwise(column)
            column = F.when(fits_column(name), new).otherwise(kept)
        if name in target_of or name in winners:
            columns[name] = column

    gone = F.map_filter(
        FIELDS,
        lambda key, _: ~key.isin(*target_of)
        & ~functools.reduce(
            lambda a, b: a | b, [(key == target) & arrives[target] for target in winners]
        ),
    )
    placed = F.filter(
        F.array(
            *[
                F.struct(
                    (
                        arrives[target] & ~fits_column(target)
                        if target in ATTRIBUTES
                        else arrives[target]
                    ).alias("use"),
                    F.lit(target).alias("key"),
                    winners[target].alias("value"),
                )
                for target in winners
            ]
        ),
        lambda item: item["use"],
    )
    moved = F.map_from_entries(F.transform(placed, lambda item: F.struct(item["key"], item["value"])))
    columns[FIELDS] = F.map_concat(gone, moved)
    return df.withColumns(columns)


# -- timestamp text ---------------------------------------------------------


def timestamp_text(df: DataFrame, name: str = "timestamp", zone: str = "UTC") -> DataFrame:
    """Write the entry's time as RFC 3339 text into ``fields[name]``."""
    require(name != "", "timestamp_text: the field name must not be empty")
    return df.withColumn(FIELDS, put(F.col(FIELDS), name, to_variant(rfc3339(F.col("timestamp"), zone))))
