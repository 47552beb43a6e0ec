"""Tables about the logs: counters, health, file availability, rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlog.plans.ordered import Previous, with_running

AVAILABLE = "available"
MISSING = "missing"
INODE_CHANGED = "inode_changed"
TRUNCATED = "truncated"
TOTAL = "*"


def pipeline_counters(
    lines: DataFrame,
    parsed: Column,
    sink_writes: Column,
    sink_errors: Column,
    by: str = "source",
    ts: Column | None = None,
) -> DataFrame:
    """Counters per source and, as source ``*``, over all.

    ``lines`` has one row per line read.  ``parsed`` says whether it became an
    entry, ``sink_writes`` and ``sink_errors`` how many deliveries of it worked
    and failed.  A line is dropped when none worked.  ``uptime_seconds`` spans
    the times in ``ts``.
    """
    counts = [
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if(parsed).alias("lines_parsed"),
        F.count_if(~parsed).alias("parse_errors"),
        F.coalesce(F.sum(sink_writes), F.lit(0)).alias("sink_writes"),
        F.coalesce(F.sum(sink_errors), F.lit(0)).alias("sink_errors"),
        F.count_if(sink_writes == 0).alias("lines_dropped"),
    ]
    if ts is not None:
        span = F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))
        counts.append((span / 1_000_000).alias("uptime_seconds"))
    totals = lines.rollup(by).agg(F.grouping(by).alias("_all"), *counts)
    label = F.when(F.col("_all") == 1, TOTAL).otherwise(F.col(by))
    return totals.withColumn(by, label).drop("_all")


def health_report(status: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """One row: ``healthy``, ``checked_at`` and the ``components``.

    ``status`` has ``name``, ``healthy``, ``detail`` and ``registered``; the
    last registration of a name counts.  No components is healthy.
    """
    latest = status.groupBy("name").agg(
        F.max_by(F.struct("healthy", F.nullif("detail", F.lit("")).alias("detail")), "registered").alias(
            "state"
        )
    )
    stamp = F.current_timestamp() if checked_at is None else checked_at
    component = F.struct(
        "name", F.col("state.healthy").alias("healthy"), F.col("state.detail").alias("detail")
    )
    return latest.agg(
        F.coalesce(F.bool_and("state.healthy"), F.lit(True)).alias("healthy"),
        F.sort_array(F.collect_list(component)).alias("components"),
    ).select("healthy", stamp.alias("checked_at"), "components")


def stale_status(
    entries: DataFrame, limit: float, now: Column | None = None, by: str = "source", ts: str = "timestamp"
) -> DataFrame:
    """Status rows for :func:`health_report`: a source is healthy while its last
    entry is at most ``limit`` seconds old at ``now`` (default: the newest entry).
    The newest entry is found among one row per source, so the entries are read once."""
    last = entries.groupBy(by).agg(F.max(ts).alias("_last"))
    reference = F.max("_last").over(Window.partitionBy()) if now is None else now
    age = F.unix_micros(reference) - F.unix_micros("_last")
    healthy = age <= round(limit * 1_000_000)
    return last.select(
        F.col(by).alias("name"),
        healthy.alias("healthy"),
        F.when(healthy, "").otherwise(F.concat(F.lit("silent for "), (age / 1_000_000).cast("bigint"), F.lit(" s"))).alias("detail"),
        F.col("_last").alias("registered"),
    )


def state_transitions(
    polls: DataFrame,
    by: Sequence[str] = ("path",),
    order: Sequence[str] = ("poll_ts",),
    available: str = "available",
    chunks: int | None = None,
) -> DataFrame:
    """Polls at which a path appears or disappears, with its new ``state``.
    The first poll of a path always counts."""
    state = F.when(F.col(available), AVAILABLE).otherwise(MISSING)
    seen = polls.withColumn("state", state)
    compared = with_running(seen, by, order, [Previous("_before", F.col("state"))], chunks)
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("state"))
    return compared.where(changed).drop("_before")


def rotation_events(
    polls: DataFrame,
    by: Sequence[str] = ("path",),
    order: Sequence[str] = ("poll_ts",),
    inode: str = "inode",
    size: str = "size",
    chunks: int | None = None,
) -> DataFrame:
    """Polls at which a file was replaced or cut, with the ``reason``.  Polls
    that found no file (NULL metadata) are skipped; the first one is the base."""
    found = polls.where(F.col(inode).isNotNull() & F.col(size).isNotNull())
    meta = F.struct(F.col(inode).alias("inode"), F.col(size).alias("size"))
    compared = with_running(found, by, order, [Previous("_before", meta)], chunks)
    reason = F.when(F.col("_before.inode") != F.col(inode), INODE_CHANGED).when(
        F.col(size) < F.col("_before.size"), TRUNCATED
    )
    return compared.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_before")
