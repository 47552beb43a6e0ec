"""Numbered envelopes around entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.model import require
from riverlog.plans.ordered import RowNumber, with_running


def wrap_envelopes(
    df: DataFrame,
    envelope_source: str,
    order: Sequence[str] = ("timestamp",),
    received_at: Column | None = None,
    dense: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``seq``, ``envelope_source`` and ``received_at``.

    ``dense=True`` numbers all entries 1, 2, 3... in arrival order, chunk by
    chunk.  ``dense=False`` is the cheap form without a shuffle, also for
    streams: numbers are unique and rise inside a partition, with gaps.
    """
    require(envelope_source != "", "envelope: the source must not be empty")
    stamp = F.current_timestamp() if received_at is None else received_at
    if dense:
        numbered = with_running(df, [], order, [RowNumber("seq")], chunks)
    else:
        numbered = df.withColumn("seq", F.monotonically_increasing_id() + 1)
    return numbered.withColumns({"envelope_source": F.lit(envelope_source), "received_at": stamp})
