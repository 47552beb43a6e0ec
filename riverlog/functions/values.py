"""Column expressions over the entry model: look-ups, text forms, JSON types.

Every operator reads values through this module, so all of them agree on what
"the field ``level``" means: the key in ``fields`` if it is there, else the
attribute column of that name when it is not empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverlog.functions.timestamps import rfc3339
from riverlog.model import ATTRIBUTES, FIELDS, TEXT_ATTRIBUTES

# Fixed value: text form of a JSON null.
NULL_TEXT = "<nil>"


def in_fields(name: str) -> Column:
    return F.coalesce(F.map_contains_key(FIELDS, name), F.lit(False))


def _field(name: str) -> Column:
    return F.col(FIELDS).getItem(name)


def attribute_text(name: str) -> Column:
    """An attribute column as text, NULL when it is empty."""
    if name == "timestamp":
        return rfc3339(F.col("timestamp"))
    return F.nullif(F.col(name), F.lit(""))


def variant_type(value: Column) -> Column:
    """JSON type of a variant: string, number, boolean, null, object or array."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.isNotNull(), "number")
    )


def variant_text(value: Column) -> Column:
    """Text of a variant: strings bare, numbers in plain decimals, rest as JSON."""
    number = F.try_variant_get(value, "$", "double")
    whole = (F.schema_of_variant(value) == "DOUBLE") & (number == F.floor(number)) & (F.abs(number) < 1e18)
    return (
        F.when(F.is_variant_null(value), NULL_TEXT)
        .when(whole, number.cast("bigint").cast("string"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def variant_string(value: Column) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def to_variant(text: Column) -> Column:
    return text.cast("variant")


def present(name: str) -> Column:
    if name in ATTRIBUTES:
        return in_fields(name) | attribute_text(name).isNotNull()
    return in_fields(name)


def field_text(name: str) -> Column:
    """Text form of a looked-up value, NULL when the entry has no such field."""
    inner = F.when(in_fields(name), variant_text(_field(name)))
    return inner.otherwise(attribute_text(name)) if name in ATTRIBUTES else inner


def field_string(name: str) -> Column:
    """The looked-up value when it is a string, else NULL."""
    inner = F.when(in_fields(name), variant_string(_field(name)))
    return inner.otherwise(attribute_text(name)) if name in ATTRIBUTES else inner


def field_type(name: str) -> Column:
    """JSON type of the looked-up value, NULL when the entry has no such field."""
    inner = F.when(in_fields(name), variant_type(_field(name)))
    if name in ATTRIBUTES:
        return inner.otherwise(F.when(attribute_text(name).isNotNull(), "string"))
    return inner


def empty_fields() -> Column:
    return F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")
    )


def put(fields: Column, name: str, value: Column) -> Column:
    """``fields`` with ``name`` set to a variant, replacing an older value."""
    return F.map_concat(drop_keys(fields, [name]), F.create_map(F.lit(name), value))


def drop_keys(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda key, _: ~key.isin(*names))


__all__ = [
    "TEXT_ATTRIBUTES",
    "attribute_text",
    "drop_keys",
    "empty_fields",
    "field_string",
    "field_text",
    "field_type",
    "in_fields",
    "present",
    "put",
    "to_variant",
    "variant_string",
    "variant_text",
    "variant_type",
]
