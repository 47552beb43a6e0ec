"""Text expressions: byte-exact truncation and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riverlog.functions.timestamps import rfc3339
from riverlog.model import FIELDS

ELLIPSIS = "..."


def truncate_bytes(text: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` bytes of UTF-8; longer text ends in an ellipsis.

    The cut is made on bytes and may fall inside a character; what is left of
    that character becomes U+FFFD when the value is read as text.
    """
    head = F.substring(F.encode(text, "UTF-8"), 1, max_bytes - len(ELLIPSIS))
    cut = F.concat(F.make_valid_utf8(head.cast("string")), F.lit(ELLIPSIS))
    return F.when(F.octet_length(text) > max_bytes, cut).otherwise(text)


def entry_json() -> Column:
    """The entry as one JSON object; ``raw`` is left out, so are empty fields."""
    names = F.array_sort(F.map_keys(FIELDS))
    ordered = F.map_from_arrays(names, F.transform(names, lambda name: F.col(FIELDS)[name]))
    return F.to_json(
        F.struct(
            rfc3339(F.col("timestamp")).alias("timestamp"),
            "level",
            "message",
            "source",
            F.when(F.size(FIELDS) > 0, ordered).alias(FIELDS),
        )
    )
