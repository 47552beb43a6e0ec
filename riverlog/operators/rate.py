"""Token-bucket shaping: when would each entry be let through?

The bucket starts full with ``burst`` tokens and gains ``rate`` tokens a second;
entries wait in order and none is dropped.  With 1-based position ``i`` and
arrival ``a_i`` the release time has a closed form,

    max(a_i, (i + 1 - burst) / rate + max over j <= i of (a_j - j / rate)),

so shaping is a row number and a running maximum instead of a simulation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.functions.timestamps import micros
from riverlog.model import require
from riverlog.plans.ordered import RowNumber, RunningMax, cut_rows, with_running


def check_rate(rate: float, burst: int) -> None:
    require(rate >= 0, f"rate: the rate must not be negative, got {rate}")
    require(burst >= 0, f"rate: the burst must not be negative, got {burst}")


def shape_rate(
    df: DataFrame,
    rate: float,
    burst: int,
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    ts: str = "timestamp",
    chunks: int | None = None,
) -> DataFrame:
    """Add ``release_at`` and ``delay``, both in microseconds.

    Exact when a second divides into whole microseconds per token, within one
    microsecond otherwise.  Entries that are never released (rate or burst of
    zero) have NULL in both.
    """
    check_rate(rate, burst)
    at = micros(F.col(ts), df.schema[ts].dataType.simpleString())
    timed = df.withColumn("_at", at)
    cut = cut_rows(timed, by, order, ["_at"], chunks)
    ranked = with_running(cut.rows, by, order, [RowNumber("_i")], cut=cut, keep_chunks=True)
    if rate == 0 or burst == 0:
        released = F.when((F.col("_i") <= burst), F.col("_at"))
    else:

        def tokens(count: Column) -> Column:
            return F.floor(count * F.lit(1_000_000 / rate))

        slack = RunningMax("_slack", F.col("_at") - tokens(F.col("_i")))
        numbered = cut.of(with_running(cut.narrow, by, order, [RowNumber("_i")], cut=cut))
        ranked = with_running(ranked, by, order, [slack], cut=numbered)
        released = F.greatest(F.col("_at"), tokens(F.col("_i") + F.lit(1 - burst)) + F.col("_slack"))
    return (
        ranked.withColumn("release_at", released)
        .withColumn("delay", F.col("release_at") - F.col("_at"))
        .select(*df.columns, "release_at", "delay")
    )


def rate_stats(shaped: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Per key: entries released at once, delayed and never, with delays.

    A rate below that of the arrivals makes delays grow with the position, and
    their total with its square: the total is a whole number of up to 38 digits.
    """
    return shaped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("delay") == 0).alias("immediate"),
        F.count_if(F.col("delay") > 0).alias("delayed"),
        F.count_if(F.col("release_at").isNull()).alias("never"),
        F.max("delay").alias("max_delay"),
        F.sum(F.col("delay").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total_delay"),
    )
