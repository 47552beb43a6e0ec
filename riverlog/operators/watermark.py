"""Delivery watermarks: what was delivered last, and what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlog.functions.timestamps import watermark_text
from riverlog.model import require


def delivery_watermark(
    delivered: DataFrame, order: Sequence[str], by: str = "source", ts: str = "timestamp"
) -> DataFrame:
    """Per source the ``position`` of the last entry in arrival order, and as
    ``watermark`` its time (which is not always the greatest) as fixed-width
    text.  Pre-aggregated per task."""
    require(len(order) > 0, "watermark: an arrival order needs at least one column")
    position = F.struct(*order)
    return delivered.groupBy(by).agg(
        watermark_text(F.max_by(ts, position)).alias("watermark"), F.max(position).alias("position")
    )


def resume_after(entries: DataFrame, marks: DataFrame, order: Sequence[str], by: str = "source") -> DataFrame:
    """Entries that arrived after their source's mark, and all of unknown sources.

    Whole positions are compared, not times: an entry as old as the last one
    delivered, or older but later to arrive, is still to do.  ``order`` must be
    the one the marks were made with, and total within a source.  One mark
    exists per source; Spark picks the join by its size.
    """
    require(len(order) > 0, "resume: an arrival order needs at least one column")
    known = marks.select(F.col(by).alias("_mark_key"), F.col("position").alias("_mark"))
    joined = entries.join(known, entries[by].eqNullSafe(known["_mark_key"]), "left")
    todo = joined.where(F.col("_mark").isNull() | (F.struct(*[entries[name] for name in order]) > F.col("_mark")))
    return todo.select(*[entries[name] for name in entries.columns])
