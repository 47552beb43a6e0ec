"""Suppression of repeated lines within a time window.

An entry is a duplicate iff the previous occurrence of the same key, kept or
dropped, is less than ``window`` earlier: every repeat restarts the clock.

Time is cut into buckets as long as the window.  Two occurrences in one bucket
are always closer than the window, so only the first entry of a (key, bucket)
can survive, and whether it does depends on one number: the last occurrence in
the bucket before.  So the lines are reduced to one row per (key, bucket), its
first entry and its last time, in one scan; a line that fills a third of the table
is reduced in the map tasks (a partial aggregate), and no window ever spans a
whole key.  These rows are written and linked to those of the bucket before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.timestamps import micros
from riverlog.model import require
from riverlog.plans.ordered import RunningSum, with_running
from riverlog.plans.storage import written


def _width(window: float) -> int:
    width = round(window * 1_000_000)
    require(width > 0, "dedup: the window must be above zero seconds")
    return width


def _bucketed(df: DataFrame, window: float, key: str | Column, ts: str) -> DataFrame:
    """Add the shuffle key (a hash: whole lines would travel through every
    sort), the time in microseconds and the start of its bucket."""
    width = _width(window)
    column = F.col(key) if isinstance(key, str) else key
    at = micros(F.col(ts), df.schema[ts].dataType.simpleString())
    return df.withColumns(
        {"_key": F.coalesce(F.sha2(column.cast("string"), 256), F.lit("")), "_at": at}
    ).withColumn("_bucket", F.col("_at") - F.pmod("_at", F.lit(width)))


def _with_bucket_before(buckets: DataFrame, width: int) -> DataFrame:
    """Add, to one row per (key, bucket) with its ``_last`` occurrence, the last
    occurrence in the bucket before.  Only key, bucket and time are read twice."""
    ends = buckets.select(
        F.col("_key").alias("_end_key"), (F.col("_bucket") + width).alias("_end_bucket"), F.col("_last").alias("_before")
    )
    match = (buckets["_key"] == ends["_end_key"]) & (buckets["_bucket"] == ends["_end_bucket"])
    return buckets.join(ends, match, "left").drop("_end_key", "_end_bucket")


def _starts_burst(width: int) -> Column:
    return F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= width)


def dedup_window(
    df: DataFrame,
    window: float,
    key: str | Column = "raw",
    ts: str = "timestamp",
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Drop duplicates less than ``window`` seconds after their previous
    occurrence.  ``order`` names columns that break ties of ``ts``."""
    bucketed = _bucketed(df, window, key, ts)
    place = F.struct("_at", *order)
    buckets = bucketed.groupBy("_key", "_bucket").agg(
        F.min_by(F.struct(*df.columns), place).alias("_entry"), F.min("_at").alias("_at"), F.max("_at").alias("_last")
    )
    linked = _with_bucket_before(written(buckets, "dedup-buckets"), _width(window))
    return linked.where(_starts_burst(_width(window))).select("_entry.*")


def dedup_bursts(
    df: DataFrame,
    window: float,
    key: str | Column = "raw",
    ts: str = "timestamp",
    chunks: int | None = None,
) -> DataFrame:
    """One row per kept line: ``key_hash``, ``first_at``, ``last_at`` (in
    microseconds) and ``occurrences``, the kept line and its duplicates.

    Occurrences are counted per (key, bucket) first; bursts are then chained
    over those rows only.
    """
    width = _width(window)
    # Written down once: measuring, linking and chaining all start from these
    # few rows instead of from the lines.
    buckets = (
        _bucketed(df, window, key, ts)
        .groupBy("_key", "_bucket")
        .agg(F.min("_at").alias("_at"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    )
    buckets = written(buckets, "burst-buckets")
    linked = _with_bucket_before(buckets, width)
    linked = linked.select("_key", "_bucket", "_at", "_last", "_n", _starts_burst(width).cast("int").alias("_head"))
    numbered = with_running(
        linked, ["_key"], ["_bucket"], [RunningSum("_burst", F.col("_head"))], chunks
    )
    return (
        numbered.groupBy(F.col("_key").alias("key_hash"), "_burst")
        .agg(
            F.min("_at").alias("first_at"),
            F.max("_last").alias("last_at"),
            F.sum("_n").alias("occurrences"),
        )
        .drop("_burst")
    )


def dedup_live_size(
    df: DataFrame, window: float, key: str | Column = "raw", ts: str = "timestamp"
) -> DataFrame:
    """One row: distinct lines still remembered when the last entry arrives,
    that is, last seen no more than ``window`` seconds before it."""
    lasts = _bucketed(df, window, key, ts).groupBy("_key").agg(F.max("_at").alias("_last"))
    lasts = written(lasts, "last-seen")
    newest = lasts.agg(F.max("_last")).scalar()
    return lasts.where(F.col("_last") >= newest - _width(window)).agg(F.count(F.lit(1)).alias("live_lines"))
