"""Jobs from a plain description: sources, sinks, nested sinks.

The description is a dict, as a config file would hold it::

    {"sources": [{"path": "/logs/app/*.log", "label": "app"}],
     "sinks": [{"type": "stdout"},
               {"type": "router", "routes": [
                   {"field": "level", "values": ["error"],
                    "sink": {"type": "file", "path": "/out/errors"}}]}]}

It is checked as a whole before anything is read.  ``build_job`` only composes
the library's operators and sinks; Spark plans and runs the result.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riverlog.model import DEFAULT_CAPACITY, Route, RuleError, require
from riverlog.operators.parse import parse_logs
from riverlog.operators.predicates import keep_expression
from riverlog.plans.commits import CommitLog, undelivered
from riverlog.plans.storage import qualified
from riverlog.sinks.basic import (
    BufferedSink,
    ConsoleSink,
    FileSink,
    FilteredSink,
    Held,
    RetrySink,
    RouterSink,
    Sink,
    fan_out,
    without_periods,
)
from riverlog.sinks.http import HttpSink, Post, open_client
from riverlog.sinks.outlets import ORIGIN
from riverlog.sinks.retry import RetryPolicy
from riverlog.sources.files import Source, union_sources
from riverlog.sources.tail import tail_logs
from riverlog.streaming.counters import LiveCounters
from riverlog.streaming.stateful import keep_latest_stream

Spec = Mapping[str, Any]

# In a stream: the number of the buffer that a row was flushed from.
FLUSHED = "_flushed"
_FLUSHED_IS_NULL = f"{FLUSHED} IS NULL"

_FALLBACK = "fallback"

# Total up to lines that are the same in all they hold.
ARRIVAL = ("timestamp", "source", "raw")


@dataclass(frozen=True)
class SinkContext:
    """What sinks share: the arrival order, the console, the HTTP client."""

    order: tuple[str, ...] = ARRIVAL
    out: Any = None
    client: Any = open_client


def _inner(spec: Spec, where: str, kind: str, context: SinkContext) -> Sink:
    require(spec.get("inner") is not None, f"{where}: {kind} sink requires an inner sink")
    return build_sink(spec["inner"], f"{where}.inner", context)


def build_sink(spec: Spec, where: str = "sink", context: SinkContext = SinkContext()) -> Sink:
    """One sink from its description; errors start with ``where``."""
    kind = spec.get("type") or ""
    require(kind != "", f"{where}: type is required")
    if kind == "stdout":
        return ConsoleSink(out=context.out)
    if kind == "http":
        require(bool(spec.get("url")), f"{where}: http sink requires a url")
        return HttpSink(
            spec["url"],
            dict(spec.get("headers") or {}),
            spec.get("per_request", 1),
            RetryPolicy(**spec.get("retry", {})),
            context.client,
        )
    if kind == "file":
        path = spec.get("path") or spec.get("file_path")
        require(bool(path), f"{where}: file sink requires a path")
        return FileSink(path, tuple(spec.get("partition_by", ())), where)
    if kind == "buffered":
        inner = _inner(spec, where, kind, context)
        capacity = spec.get("capacity") or 0
        capacity = capacity if capacity > 0 else DEFAULT_CAPACITY
        by, period = tuple(spec.get("by", ())), spec.get("flush_seconds")
        require(period is None or period > 0, f"{where}: flush_seconds must be above zero")
        return BufferedSink(inner, capacity, by, context.order, period, spec.get("lateness_seconds", 0.0))
    if kind == "sampled":
        inner = _inner(spec, where, kind, context)
        rate, seed, key = spec.get("rate", 0), spec.get("seed"), spec.get("key")
        try:
            keep_expression(rate, seed, None)
        except RuleError as error:
            raise RuleError(f"{where}: {error}") from None
        return FilteredSink(lambda: keep_expression(rate, seed, key), inner)
    if kind == "retry":
        inner = _inner(spec, where, kind, context)
        try:
            policy = RetryPolicy(**spec.get("retry", {}))
        except (RuleError, TypeError) as error:
            raise RuleError(f"{where}: {error}") from None
        return RetrySink(inner, policy, spec.get("dead_letters"))
    if kind == "router":
        return _router(spec, where, context)
    raise RuleError(f"{where}: unknown type {kind!r}")


def _router(spec: Spec, where: str, context: SinkContext) -> RouterSink:
    described: Sequence[Spec] = spec.get("routes") or ()
    require(len(described) > 0, f"{where}: router sink requires routes")
    routes, sinks = [], {}
    for position, entry in enumerate(described):
        place = f"{where}.route[{position}]"
        require(bool(entry.get("field")), f"{place}: missing field")
        require(bool(entry.get("values")), f"{place}: missing values")
        require(entry.get("sink") is not None, f"{place}: missing sink")
        name = str(position)
        sinks[name] = build_sink(entry["sink"], f"{place}.sink", context)
        routes.append(Route(entry["field"], [str(value) for value in entry["values"]], name))
    if spec.get("fallback") is None:
        return RouterSink(routes, sinks)
    sinks[_FALLBACK] = build_sink(spec["fallback"], f"{where}.fallback", context)
    return RouterSink(routes, sinks, _FALLBACK)


@dataclass(frozen=True)
class Job:
    """Sources and sinks, checked and ready to run on tables or as a stream."""

    sources: tuple[Source, ...]
    sinks: tuple[Sink, ...]
    raw: bool = False
    max_bytes: int | None = None  # of each source in a micro-batch

    def entries(self, spark: SparkSession, with_position: bool = False) -> tuple[DataFrame, list[Source]]:
        """All entries of all sources, and the sources that could not be opened."""
        lines, skipped = union_sources(spark, self.sources, with_position)
        return parse_logs(lines, raw=self.raw), skipped

    def run(self, spark: SparkSession, commits: str | CommitLog | None = None) -> list[Source]:
        """Deliver everything that is there now; returns the skipped sources.

        With ``commits``, a shared folder, a run delivers what no earlier run has:
        entries behind the committed place of their file.  Marks are committed
        after all sinks have succeeded; a run that stops before that is repeated
        by the next one under the same batch id.  Files may grow and be added;
        for files that are replaced use ``start``.
        """
        if commits is None:
            entries, skipped = self.entries(spark)
            fan_out(entries, self.sinks)
            return skipped
        log = commits if isinstance(commits, CommitLog) else CommitLog(spark, commits)
        entries, skipped = self.entries(spark, with_position=True)
        latest = log.latest()
        self.deliver(undelivered(entries, log), 0 if latest is None else latest + 1, log)
        return skipped

    def deliver(
        self,
        entries: DataFrame,
        batch_id: int | None = None,
        log: CommitLog | None = None,
        counters: LiveCounters | None = None,
    ) -> None:
        """Give a batch to all sinks, then commit it; a committed one is skipped."""
        if log is not None and log.committed(batch_id):
            return
        if log is None:
            fan_out(entries, self.sinks, batch_id)
            return
        entries = entries.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            report = None if counters is None else functools.partial(counters.delivered, batch_id)
            fan_out(entries, self._for(entries), batch_id, held=True, report=report)
            log.commit(batch_id, entries.where(_FLUSHED_IS_NULL) if FLUSHED in entries.columns else entries)
        finally:
            entries.unpersist()

    def _for(self, entries: DataFrame) -> list[Sink]:
        """The sinks of a micro-batch, each with its own rows where a stream's
        buffers were flushed into it."""
        if FLUSHED not in entries.columns:
            return list(self.sinks)
        sinks, number = [], 0
        for sink in self.sinks:
            rest, held = without_periods(sink)
            if rest is not None:
                sinks.append(FilteredSink(lambda: F.expr(_FLUSHED_IS_NULL), rest))
            for buffer in held:
                sinks.append(FilteredSink(functools.partial(_flushed_from, number), buffer.buffer.inner))
                number += 1
        return sinks

    def start(
        self,
        spark: SparkSession,
        checkpoint: str,
        start: str = "latest",
        trigger: Mapping[str, Any] | None = None,
        log: CommitLog | None = None,
        counters: LiveCounters | None = None,
    ) -> StreamingQuery:
        """Follow all sources as one stream.  Files that are missing are picked
        up when they appear.

        ``checkpoint`` keeps the places in the files and, under ``delivered``, the
        commits: a restart goes on behind the last batch, whatever ``start`` says.
        A batch whose sinks have not all succeeded is replayed whole, under its
        batch id; file sinks replace what they had of it, and a batch that was
        committed before is not delivered again.  ``counters`` counts lines and
        deliveries by source while the query runs.
        """
        require(bool(checkpoint), "job: a checkpoint folder is required to follow sources")
        log = log or CommitLog(spark, checkpoint, "delivered")
        if counters is not None:
            spark.streams.addListener(counters)
        parts = []
        for number, source in enumerate(self.sources):
            places = f"{qualified(spark, checkpoint)}/places/{number}.json"
            lines = tail_logs(spark, source.path, source.label, start, max_bytes=self.max_bytes, places=places)
            lines = lines if counters is None else counters.read(lines, number)
            entries = parse_logs(lines, raw=self.raw).withColumn(ORIGIN, F.lit(source.label or source.path))
            parts.append(entries if counters is None else counters.parsed(entries, number))
        entries = functools.reduce(DataFrame.unionByName, parts)
        query = (
            _with_flushes(entries, [held for sink in self.sinks for held in without_periods(sink)[1]])
            .writeStream.foreachBatch(functools.partial(self.deliver, log=log, counters=counters))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "250 milliseconds"}))
            .start()
        )
        if counters is not None:
            counters.follow(str(query.id), [source.label or source.path for source in self.sources])
        return query


def _flushed_from(number: int) -> Column:
    return F.col(FLUSHED) == number


def _with_flushes(entries: DataFrame, buffers: Sequence[Held]) -> DataFrame:
    """Entries as they come, and beside them the flushes of the buffers."""
    if not buffers:
        return entries
    parts = [entries.withColumn(FLUSHED, F.lit(None).cast("int"))]
    for number, held in enumerate(buffers):
        mine = functools.reduce(lambda df, condition: df.where(condition()), held.conditions, entries)
        b = held.buffer
        newest = keep_latest_stream(mine, b.capacity, b.period, b.by, b.order, lateness=b.lateness)
        parts.append(newest.drop("buffer_pos").withColumn(FLUSHED, F.lit(number)))
    return functools.reduce(DataFrame.unionByName, parts)


def build_job(
    spec: Spec,
    order: Sequence[str] = ARRIVAL,
    out: Any = None,
    client: Any = open_client,
) -> Job:
    """Check a description and compose the job; one bad part fails the whole."""
    context = SinkContext(tuple(order), out, client)
    described = spec.get("sources") or ()
    require(len(described) > 0, "config must define at least one source")
    sources = []
    for position, entry in enumerate(described):
        require(bool(entry.get("path")), f"source[{position}]: path is required")
        sources.append(Source(entry["path"], entry.get("label") or entry.get("tag")))
    outputs = spec.get("sinks") or ()
    require(len(outputs) > 0, "config must define at least one sink")
    sinks = [build_sink(entry, f"sink[{position}]", context) for position, entry in enumerate(outputs)]
    max_bytes = spec.get("max_bytes")
    require(max_bytes is None or max_bytes > 0, "config: max_bytes must be above zero")
    return Job(tuple(sources), tuple(sinks), bool(spec.get("raw", False)), max_bytes)


__all__ = ["Job", "Post", "SinkContext", "build_job", "build_sink"]
