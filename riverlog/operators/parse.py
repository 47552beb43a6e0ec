"""Lines of text to entries, and entries back to lines."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.text import entry_json
from riverlog.functions.timestamps import parse_rfc3339
from riverlog.functions.values import empty_fields, variant_string
from riverlog.model import (
    FIELDS,
    LEVEL_KEYS,
    MESSAGE_KEYS,
    RAW,
    TIMESTAMP_KEYS,
    RuleError,
)

# A line is parsed as the first item of a two-item array whose second item is
# an object with this key.  Trailing garbage, a second document or a stray
# bracket breaks the shape, so the (lenient) JSON reader accepts whole objects
# only.  The key is random: no line can contain it by design.
_SENTINEL = uuid.uuid4().hex
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

EMPTY_LINE = "empty line"
NOT_AN_OBJECT = "not an object"
INVALID_JSON = "invalid JSON"


def _strict(line: Column, item: str) -> Column:
    text = F.concat(F.lit("["), line, F.lit(',{"' + _SENTINEL + '":0}]'))
    return F.from_json(text, f"array<{item}>", _JSON_OPTIONS)


def _last_key_wins(parsed: Column) -> Column:
    """Drop earlier values of repeated keys; the JSON reader keeps them all."""

    def rebuilt(items: Column) -> Column:
        return F.map_from_entries(
            F.filter(
                items,
                lambda item, i: ~F.exists(
                    F.slice(items, i + 2, F.size(items)), lambda later: later["key"] == item["key"]
                ),
            )
        )

    keys = F.map_keys(parsed)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), parsed).otherwise(
        rebuilt(F.map_entries(parsed))
    )


def _with_document(df: DataFrame, value_col: str) -> DataFrame:
    """Add ``_doc``, the line's map of values, and ``_rest``, the part of it that
    feeds no attribute; both NULL when the line is malformed.

    Both come out of a generator on purpose: predicates on its output are not
    pushed below it, so a line is decoded once however the result is used, and
    whatever an operator looks up in the fields is a plain column read.
    """
    consumed = [*TIMESTAMP_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS]
    whole_object = F.filter(
        F.array(_strict(F.col(value_col), "map<string,variant>")),
        lambda items: (F.size(items) == 2) & F.map_contains_key(items[1], _SENTINEL),
    )
    documents = F.transform(
        whole_object, lambda items: _last_key_wins(F.coalesce(items[0], empty_fields()))
    )
    parts = F.transform(
        documents,
        lambda doc: F.struct(
            doc.alias("_doc"), F.map_filter(doc, lambda key, _: ~key.isin(*consumed)).alias("_rest")
        ),
    )
    return df.select("*", F.inline_outer(parts))


def _first_string(keys: Sequence[str]) -> Column:
    return F.coalesce(*[variant_string(F.col("_doc").getItem(key)) for key in keys])


def _event_time(now: Column) -> Column:
    parsed = F.coalesce(
        *[parse_rfc3339(variant_string(F.col("_doc").getItem(key))) for key in TIMESTAMP_KEYS]
    )
    unset = F.lit("0001-01-01T00:00:00Z").cast("timestamp")
    return F.coalesce(F.nullif(parsed, unset), now)


def parse_logs(
    df: DataFrame,
    value_col: str = "value",
    source: str | Column | None = None,
    now: Column | None = None,
    raw: bool = False,
) -> DataFrame:
    """Parse lines into entries.  Malformed lines are dropped, or, with
    ``raw=True``, become entries whose message is the line itself.

    ``source`` is a label, a column, or None to keep the input's ``source``.
    ``now`` replaces the processing time given to entries without a usable
    timestamp.  Columns other than ``value_col`` pass through.
    """
    documents = _with_document(df, value_col)
    if not raw:
        documents = documents.where(F.col("_doc").isNotNull())
    return _entries(documents, df.columns, value_col, source, now, raw)


def _entries(
    documents: DataFrame,
    columns: Sequence[str],
    value_col: str,
    source: str | Column | None,
    now: Column | None,
    raw: bool,
) -> DataFrame:
    """Entries of decoded lines, with those of ``columns`` that pass through."""
    stamp = F.current_timestamp() if now is None else now
    if source is None:
        if "source" not in columns:
            raise RuleError("parse: give a source label, or an input column named source")
        label = F.col("source")
    else:
        label = F.lit(source) if isinstance(source, str) else source

    line = F.col(value_col)
    good = F.col("_doc").isNotNull()
    message = F.coalesce(_first_string(MESSAGE_KEYS), F.lit(""))
    passthrough = [name for name in columns if name not in (value_col, "source")]
    return documents.select(
        _event_time(stamp).alias("timestamp"),
        F.coalesce(_first_string(LEVEL_KEYS), F.lit("")).alias("level"),
        (F.when(good, message).otherwise(line) if raw else message).alias("message"),
        label.alias("source"),
        (F.coalesce("_rest", empty_fields()) if raw else F.col("_rest")).alias(FIELDS),
        line.alias(RAW),
        *passthrough,
    )


def _reason(line: Column) -> Column:
    """Why a malformed line is none that can be parsed."""
    single_value = F.size(_strict(line, "variant")) == 2
    return (
        F.when(F.coalesce(line, F.lit("")) == "", EMPTY_LINE)
        .when(F.coalesce(single_value, F.lit(False)), NOT_AN_OBJECT)
        .otherwise(INVALID_JSON)
    )


def malformed_lines(df: DataFrame, value_col: str = "value") -> DataFrame:
    """The lines :func:`parse_logs` drops, with ``raw`` and a ``reason``."""
    line = F.col(value_col)
    documents = _with_document(df, value_col).where(F.col("_doc").isNull()).drop("_rest")
    passthrough = [name for name in df.columns if name != value_col]
    return documents.select(line.alias(RAW), _reason(line).alias("reason"), *passthrough)


def judged_lines(
    df: DataFrame, value_col: str = "value", source: str | Column | None = None, now: Column | None = None
) -> DataFrame:
    """All lines as entries, with a ``reason`` where a line is malformed: its
    message is the line itself, as with ``raw=True``.  A line is decoded once."""
    judged = _with_document(df, value_col)
    line = F.col(value_col)
    reason = F.when(F.col("_doc").isNull(), _reason(line))
    return _entries(judged.withColumn("reason", reason), [*df.columns, "reason"], value_col, source, now, True)


def split_malformed(
    df: DataFrame, value_col: str = "value", source: str | Column | None = None, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(entries, malformed)``: two plans over the same lines, also of a stream.
    To use both of a table, write :func:`judged_lines` once and filter that."""
    return parse_logs(df, value_col, source, now), malformed_lines(df, value_col)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per entry in a single ``value`` column."""
    return df.select(entry_json().alias("value"))
