"""Drop-oldest buffering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverlog.functions.timestamps import micros
from riverlog.model import DEFAULT_CAPACITY, require


def check_capacity(capacity: int) -> None:
    require(capacity > 0, f"keep_latest: the capacity must be above zero, got {capacity}")


def keep_latest(
    df: DataFrame,
    capacity: int = DEFAULT_CAPACITY,
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    period: float | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """Per key, and per flush period of that many seconds if given, the newest
    ``capacity`` entries, with ``buffer_pos`` 1 for the oldest one kept.

    Each key is ranked per input partition first, which spreads a hot key over
    many tasks; the final rank sees at most ``capacity`` rows of each.
    """
    check_capacity(capacity)
    keys = list(by)
    if period is not None:
        width = round(period * 1_000_000)
        require(width > 0, "keep_latest: the period must be above zero seconds")
        at = micros(F.col(ts), df.schema[ts].dataType.simpleString())
        df = df.withColumn("_period", at - F.pmod(at, F.lit(width)))
        keys.append("_period")
    newest_first = [F.col(name).desc() for name in order]
    if not keys:
        # One buffer for everything: a distributed top-k, bounded by capacity.
        df = df.orderBy(*newest_first).limit(capacity)
    df = df.withColumn("_slice", F.spark_partition_id())
    local = Window.partitionBy(*keys, "_slice").orderBy(*newest_first)
    # Any slicing gives the same result: the newest overall are among the
    # newest of their slice.
    df = df.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= capacity)
    df = df.drop("_slice", "_local")
    newest = Window.partitionBy(*keys).orderBy(*newest_first)
    kept = df.withColumn("_newest", F.row_number().over(newest)).where(F.col("_newest") <= capacity)
    size = F.max("_newest").over(Window.partitionBy(*keys))
    return kept.withColumn("buffer_pos", (size - F.col("_newest") + 1).cast("bigint")).drop("_newest", "_period")
