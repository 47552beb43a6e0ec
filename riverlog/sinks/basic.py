"""Console and file sinks, and sinks that transform or split what they get.

A sink is anything with ``write(entries, batch_id=None)``.  In a stream the
batch id lets a sink recognise a replayed micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from riverlog.functions.text import entry_json
from riverlog.model import Route, require
from riverlog.operators.buffer import keep_latest
from riverlog.operators.parse import to_json_lines
from riverlog.operators.route import ROUTE, route, route_expression
from riverlog.sinks.http import HttpSink
from riverlog.sinks.outlets import Branch, ConsoleOutlet, Delivery, FileOutlet, deliver, failure_text
from riverlog.sinks.retry import RetryPolicy


class Sink(Protocol):
    def write(self, entries: DataFrame, batch_id: int | None = None) -> None: ...


@dataclass(frozen=True)
class ConsoleSink:
    """Print every entry as a JSON line.

    Without ``out`` the tasks print, each to its own standard output, so nothing
    passes through the driver.  With ``out`` the lines come to the driver one
    partition at a time and are given to it there.
    """

    out: Callable[[str], object] | None = None

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        lines = to_json_lines(entries)
        if self.out is None:
            lines.foreachPartition(_print_lines)
        else:
            for row in lines.toLocalIterator():
                self.out(row["value"])


def _print_lines(rows: Iterable[Row]) -> None:
    for row in rows:
        print(row["value"], flush=True)


@dataclass(frozen=True)
class FileSink:
    """Append JSON lines to a directory.

    A micro-batch goes to a folder of its own that a replay overwrites, so each
    entry ends up in the directory once.  ``name`` keeps sinks that share a
    directory apart.
    """

    path: str
    partition_by: tuple[str, ...] = ()
    name: str = "sink"

    def __post_init__(self) -> None:
        require(self.path != "", "file sink requires a path")

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        lines = entries.select(*self.partition_by, entry_json().alias("value"))
        target = self.path.rstrip("/")
        if batch_id is not None:
            target += f"/batch={batch_id}/sink={self.name}"
        writer = lines.write.mode("append" if batch_id is None else "overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.text(target)


@dataclass(frozen=True)
class TransformedSink:
    """Run an operator on the entries before the inner sink sees them."""

    operator: Callable[[DataFrame], DataFrame]
    inner: Sink

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        self.inner.write(self.operator(entries), batch_id)


@dataclass(frozen=True)
class FilteredSink:
    """Give the inner sink the entries for which a condition holds."""

    condition: Callable[[], Column]
    inner: Sink

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        self.inner.write(entries.where(self.condition()), batch_id)


@dataclass(frozen=True)
class BufferedSink:
    """Give the inner sink the newest ``capacity`` entries of every flush.

    On tables a flush is a key, or a key and ``period`` of event time.  In a
    stream without a period it is a micro-batch; with one, a job keeps the open
    periods in the stream's state and flushes them as they end."""

    inner: Sink
    capacity: int
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ("timestamp",)
    period: float | None = None
    lateness: float = 0.0

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        newest = keep_latest(entries, self.capacity, self.by, self.order, self.period)
        self.inner.write(newest.drop("buffer_pos"), batch_id)


@dataclass(frozen=True)
class RetrySink:
    """Try deliveries of the inner sink again, in the tasks.

    What is still undelivered after the last attempt is raised at the end, or
    kept in the folder ``dead_letters`` with its error and the attempts made.
    Works for console, file and HTTP sinks and for what filters or routes to
    them; a sink of your own is tried again as a whole, on the driver.
    """

    inner: Sink
    retry: RetryPolicy
    dead_letters: str | None = None

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        if branches_of(self, entries) is None:
            self.retry.run(lambda: self.inner.write(entries, batch_id))
        else:
            raise_joined(write_each(entries, [("", self)], batch_id))


@dataclass(frozen=True)
class RouterSink:
    """Give every entry to the sink of its route, or to the fallback."""

    routes: Sequence[Route]
    sinks: Mapping[str, Sink]
    fallback: str | None = field(default=None)

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        if branches_of(self, entries) is not None:
            raise_joined(write_each(entries, [("", self)], batch_id))
            return
        routed = route(entries, self.routes, self.fallback)
        errors = write_each(
            routed,
            [
                (name, TransformedSink(lambda df, name=name: df.where(F.col(ROUTE) == name).drop(ROUTE), sink))
                for name, sink in self.sinks.items()
            ],
            batch_id,
        )
        raise_joined(errors)


def branches_of(sink: Sink, entries: DataFrame) -> list[Branch] | None:
    """The sink as outlets of a single pass; None where it needs a job of its
    own: a sink of the user's, lines for the driver, an operator on many rows."""
    match sink:
        case FileSink():
            return [Branch(FileOutlet(sink.name, path=sink.path, partition_by=tuple(sink.partition_by)))]
        case HttpSink():
            return [Branch(sink.outlet())]
        case ConsoleSink(out=None):
            return [Branch(ConsoleOutlet("console"))]
        case FilteredSink():
            return _narrowed(branches_of(sink.inner, entries), sink.condition())
        case RetrySink():
            inner = branches_of(sink.inner, entries)
            if inner is None:
                return None
            return [
                replace(b, outlet=replace(b.outlet, retry=sink.retry, dead_letters=sink.dead_letters)) for b in inner
            ]
        case RouterSink():
            taken = route_expression(sink.routes, sink.fallback)
            found: list[Branch] = []
            for name, inner in sink.sinks.items():
                branches = _narrowed(branches_of(inner, entries), taken == name)
                if branches is None:
                    return None
                found += branches
            return found
    return None


@dataclass(frozen=True)
class Held:
    """A buffer that a stream flushes by itself, and which entries it gets."""

    buffer: BufferedSink
    conditions: tuple[Callable[[], Column], ...] = ()


def without_periods(sink: Sink) -> tuple[Sink | None, list[Held]]:
    """The sink without its buffers that have a flush period, and those buffers."""
    match sink:
        case BufferedSink() if sink.period is not None:
            return None, [Held(sink)]
        case FilteredSink():
            inner, held = without_periods(sink.inner)
            held = [replace(h, conditions=(sink.condition, *h.conditions)) for h in held]
            return None if inner is None else replace(sink, inner=inner), held
        case RetrySink():
            inner, held = without_periods(sink.inner)
            held = [replace(h, buffer=replace(h.buffer, inner=replace(sink, inner=h.buffer.inner))) for h in held]
            return None if inner is None else replace(sink, inner=inner), held
        case RouterSink():
            kept: dict[str, Sink] = {}
            found: list[Held] = []
            for name, inner in sink.sinks.items():
                rest, held = without_periods(inner)

                def taken(name: str = name) -> Column:
                    return route_expression(sink.routes, sink.fallback) == name

                found += [replace(h, conditions=(taken, *h.conditions)) for h in held]
                if rest is not None:
                    kept[name] = rest
            return replace(sink, sinks=kept) if kept else None, found
    return sink, []


def _narrowed(branches: list[Branch] | None, condition: Column) -> list[Branch] | None:
    if branches is None:
        return None
    return [replace(b, condition=condition if b.condition is None else condition & b.condition) for b in branches]


class FanOutError(RuntimeError):
    """At least one sink failed; all others got their entries."""


def write_each(
    entries: DataFrame,
    sinks: Sequence[tuple[str, Sink]],
    batch_id: int | None = None,
    held: bool = False,
    report: Callable[[Delivery], None] | None = None,
) -> list[str]:
    """Write to every sink; collect what failed instead of stopping.

    All sinks that can be outlets of a single pass share one job over the
    entries.  Only where other sinks need jobs of their own besides are the
    entries persisted, so that lines are read and parsed once (``held``: the
    caller has done so).  Lost blocks are recomputed by Spark.
    """
    shared = [(n, branches) for n, (_, sink) in enumerate(sinks) if (branches := branches_of(sink, entries)) is not None]
    if len(shared) == 1 and isinstance(sinks[shared[0][0]][1], FileSink) and report is None:
        shared = []  # Spark's own writer is the shorter way
    apart = [n for n in range(len(sinks)) if n not in dict(shared)]
    errors: dict[int, str] = {}
    persist = len(apart) + bool(shared) > 1 and not held
    if persist:
        entries = entries.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if shared:
            try:
                delivery = deliver(entries, [b for _, branches in shared for b in branches], batch_id)
                if report is not None:
                    report(delivery)
                outcomes = iter(delivery.outcomes)
                for number, branches in shared:
                    failed = [
                        failure_text(branch.outlet, outcome)
                        for branch, outcome in zip(branches, outcomes)
                        if outcome.failed and branch.outlet.dead_letters is None
                    ]
                    if failed:
                        errors[number] = "; ".join(failed)
            except Exception as error:  # noqa: BLE001 - the other sinks still get their entries
                errors |= {number: str(error) for number, _ in shared}
        for number in apart:
            try:
                sinks[number][1].write(entries, batch_id)
            except Exception as error:  # noqa: BLE001 - isolation between sinks is the point
                errors[number] = str(error)
    finally:
        if persist:
            entries.unpersist()
    return [errors[number] for number in sorted(errors)]


def raise_joined(errors: Sequence[str]) -> None:
    if errors:
        raise FanOutError("fanout errors: " + "; ".join(errors))


def fan_out(
    entries: DataFrame,
    sinks: Sequence[Sink],
    batch_id: int | None = None,
    held: bool = False,
    report: Callable[[Delivery], None] | None = None,
) -> None:
    """Every sink gets every entry; errors are raised together at the end."""
    if sinks:
        raise_joined(write_each(entries, [("", sink) for sink in sinks], batch_id, held, report))
