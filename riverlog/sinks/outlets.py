"""Many sinks fed in one pass, by a data source that Spark writes to.

``save`` turns entries into rows of one line each and the list of outlets it goes
to, and writes them to the data source ``riverlog_outlets``: one job, one scan, no
persisted copy.  A task feeds all outlets of its rows, retries what fails, writes
what cannot be delivered to a dead-letter table and goes on; a sink that is down
never stops the others or makes Spark send a whole task again.

Files appear only when the whole job has succeeded: a task writes under a name of
its own in a hidden folder beside the target, tells the driver in its commit
message, and the commit moves the files of the attempts that count.  A job that
fails leaves nothing, a replayed micro-batch replaces what it wrote before.  HTTP
delivery is at least once; a replay carries the same key.

What the driver gets is a report: one small record per task and outlet, with
counts by origin (the job's source of an entry, or its ``source``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceStreamArrowWriter,
    WriterCommitMessage,
)

from riverlog.functions.text import entry_json
from riverlog.model import require
from riverlog.plans.storage import filesystem, qualified, scratch_path
from riverlog.sinks.retry import RetriesExhausted, RetryPolicy

# Characters a partition folder must not hold, as Spark reads them
# back, and the folder of a missing value.
_UNSAFE = re.compile(r'[\x00-\x1f"#%\'*/:=?\\\x7f{\[\]^]')
_MISSING = "__HIVE_DEFAULT_PARTITION__"

# The column that names the job's source of an entry, where there is one.
ORIGIN = "_origin"

DEAD_LETTER = "sink string, entry string, error string, attempts int"


# -- files ------------------------------------------------------------------


def folder_of(names: Sequence[str], values: Sequence[str | None]) -> str:
    """A partition folder as Spark's readers know it."""
    parts = [
        f"{name}={_MISSING if not value else _UNSAFE.sub(lambda found: f'%{ord(found[0]):02X}', value)}"
        for name, value in zip(names, values)
    ]
    return "/".join(parts)


@dataclass
class Written:
    """A finished file of one task: where it is, where it belongs, and how much
    of it is good."""

    staged: str
    final: str
    size: int
    torn: bool = False


class _FileChannel:
    """Appends lines to files of this task, one per partition folder."""

    def __init__(self, target: str, run: str, names: Sequence[str]) -> None:
        self.store, self.target = filesystem(target)
        self.run, self.names = run, tuple(names)
        self.open: dict[str, tuple[Any, Written]] = {}
        self.done: list[Written] = []

    def send(self, lines: Sequence[str], values: Sequence[Sequence[str | None]]) -> None:
        groups: dict[str, list[str]] = {}
        if self.names:
            for line, of_line in zip(lines, values):
                groups.setdefault(folder_of(self.names, of_line), []).append(line)
        elif lines:
            groups[""] = list(lines)
        for folder, mine in groups.items():
            self._append(folder, ("\n".join(mine) + "\n").encode("utf-8"))

    def _append(self, folder: str, data: bytes) -> None:
        if folder not in self.open:
            name = f"part-{uuid.uuid4().hex}.txt"
            staged = "/".join(p for p in (self.target, f"_staged-{self.run}", folder) if p)
            self.store.create_dir(staged, recursive=True)
            final = "/".join(p for p in (folder, name) if p)
            self.open[folder] = self.store.open_output_stream(f"{staged}/{name}"), Written(f"{staged}/{name}", final, 0)
        stream, file = self.open[folder]
        try:
            stream.write(data)
        except Exception:
            # what was written before counts; the rest of this file does not
            file.torn = True
            self._finish(folder)
            raise
        file.size += len(data)

    def _finish(self, folder: str) -> None:
        stream, file = self.open.pop(folder)
        try:
            stream.close()
        finally:
            if file.size:
                self.done.append(file)

    def close(self) -> list[Written]:
        for folder in list(self.open):
            self._finish(folder)
        return self.done


# -- outlets ----------------------------------------------------------------


@dataclass(frozen=True)
class Outlet:
    """Where lines can go.  ``size`` lines make one delivery; ``None`` takes what
    there is.  ``dead_letters`` is a folder for what could not be delivered."""

    name: str
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    dead_letters: str | None = None
    size: int | None = None

    def channel(self, run: str, batch_id: int | None) -> Any:
        raise NotImplementedError

    def settle(self, run: str, files: Sequence[Written], batch_id: int | None) -> None:
        """On the driver, once: make what the tasks wrote visible."""

    def discard(self, run: str, batch_id: int | None) -> None:
        """On the driver, once: drop what the tasks of a failed job wrote."""


@dataclass(frozen=True)
class FileOutlet(Outlet):
    """Text files in a folder; a micro-batch has a folder of its own there."""

    path: str = ""
    partition_by: tuple[str, ...] = ()

    def target(self, batch_id: int | None) -> str:
        path = self.path.rstrip("/")
        return path if batch_id is None else f"{path}/batch={batch_id}/sink={self.name}"

    def channel(self, run: str, batch_id: int | None) -> _FileChannel:
        return _FileChannel(self.path.rstrip("/"), f"{run}-{self.name}", self.partition_by)

    def settle(self, run: str, files: Sequence[Written], batch_id: int | None) -> None:
        store, target = filesystem(self.target(batch_id))
        if batch_id is not None and store.get_file_info(target).type != fs.FileType.NotFound:
            store.delete_dir(target)
        store.create_dir(target, recursive=True)
        made = {""}
        for file in files:
            folder = file.final.rpartition("/")[0]
            if folder not in made:
                store.create_dir(f"{target}/{folder}", recursive=True)
                made.add(folder)
            if file.torn:
                with store.open_input_file(file.staged) as torn, store.open_output_stream(f"{target}/{file.final}") as out:
                    out.write(torn.read(file.size))
            else:
                store.move(file.staged, f"{target}/{file.final}")
        self.discard(run, batch_id)

    def discard(self, run: str, batch_id: int | None) -> None:
        store, path = filesystem(f"{self.path.rstrip('/')}/_staged-{run}-{self.name}")
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class _ConsoleChannel:
    def send(self, lines: Sequence[str], values: Sequence) -> None:
        print("\n".join(lines), flush=True)

    def close(self) -> list[Written]:
        return []


@dataclass(frozen=True)
class ConsoleOutlet(Outlet):
    def channel(self, run: str, batch_id: int | None) -> _ConsoleChannel:
        return _ConsoleChannel()


class _HttpChannel:
    def __init__(self, outlet: HttpOutlet, batch_id: int | None) -> None:
        self.outlet, self.batch_id, self.post = outlet, batch_id, outlet.client()

    def send(self, lines: Sequence[str], values: Sequence) -> None:
        single = self.outlet.size == 1
        body = (lines[0] if single else "[" + ",".join(lines) + "]").encode("utf-8")
        headers = dict(self.outlet.headers)
        if self.batch_id is not None:
            # Replays of a micro-batch carry the same key.
            headers["Idempotency-Key"] = hashlib.sha256(f"{self.batch_id}:".encode() + body).hexdigest()
        status = self.post(self.outlet.url, body, headers)
        if not 200 <= status < 300:
            raise RuntimeError(f"unexpected status {status} from {self.outlet.url}")

    def close(self) -> list[Written]:
        return []


@dataclass(frozen=True)
class HttpOutlet(Outlet):
    url: str = ""
    headers: tuple[tuple[str, str], ...] = ()
    client: Callable[[], Any] | None = None

    def channel(self, run: str, batch_id: int | None) -> _HttpChannel:
        return _HttpChannel(self, batch_id)


# -- in the task ------------------------------------------------------------


@dataclass
class Outcome:
    """What one task did with one outlet, or all tasks with it.  ``by_origin``
    holds the delivered and failed entries of each origin."""

    delivered: int = 0
    failed: int = 0
    attempts: int = 0
    error: str | None = None
    by_origin: dict[str, list[int]] = field(default_factory=dict)

    def add(self, other: Outcome) -> None:
        self.delivered += other.delivered
        self.failed += other.failed
        self.attempts += other.attempts
        self.error = self.error or other.error
        for origin, counts in other.by_origin.items():
            mine = self.by_origin.setdefault(origin, [0, 0])
            mine[0] += counts[0]
            mine[1] += counts[1]

    def count(self, origins: Iterable[str], at: int) -> None:
        for origin in origins:
            self.by_origin.setdefault(origin, [0, 0])[at] += 1

    def all_failed(self, error: Exception) -> None:
        self.failed, self.delivered, self.error = self.failed + self.delivered, 0, str(error)
        self.by_origin = {origin: [0, sum(counts)] for origin, counts in self.by_origin.items()}


class _Reached:
    """Which rows of a task have reached a sink, a byte each, and their origins."""

    def __init__(self) -> None:
        self.flags = bytearray()
        self.codes = array("i")
        self.names: list[str] = []
        self.known: dict[str, int] = {}

    def add(self, origins: Sequence[str | None]) -> int:
        first = len(self.flags)
        self.flags.extend(bytes(len(origins)))
        for origin in origins:
            origin = origin or ""
            if origin not in self.known:
                self.known[origin] = len(self.names)
                self.names.append(origin)
            self.codes.append(self.known[origin])
        return first

    def origins_of(self, rows: Iterable[int]) -> list[str]:
        return [self.names[self.codes[row]] for row in rows]

    def mark(self, rows: Sequence[int]) -> list[str]:
        for row in rows:
            self.flags[row] = 1
        return self.origins_of(rows)

    def totals(self) -> dict[str, int]:
        counts = np.bincount(
            np.asarray(self.codes, dtype=np.int64), np.frombuffer(bytes(self.flags), dtype=np.uint8), len(self.names)
        )
        return {name: int(count) for name, count in zip(self.names, counts)}


class _Feed:
    """One outlet in one task: gathers lines, delivers, retries, gives up."""

    def __init__(self, outlet: Outlet, run: str, batch_id: int | None, dead: _FileChannel | None, reached: _Reached) -> None:
        self.outlet, self.run, self.batch_id, self.dead, self.reached = outlet, run, batch_id, dead, reached
        self.channel: Any = None
        self.outcome = Outcome()
        self.lines: list[str] = []
        self.values: list[Any] = []
        self.rows: list[int] = []

    def put(self, lines: Sequence[str], values: Sequence[Any], rows: Sequence[int]) -> None:
        self.lines += lines
        self.values += values
        self.rows += rows
        size = self.outlet.size or max(1, len(self.lines))
        whole = len(self.lines) // size * size
        for begin in range(0, whole, size):
            part = slice(begin, begin + size)
            self._deliver(self.lines[part], self.values[part], self.rows[part])
        self.lines, self.values, self.rows = self.lines[whole:], self.values[whole:], self.rows[whole:]

    def _deliver(self, lines: list[str], values: list[Any], rows: list[int]) -> None:
        tried = 0

        def attempt() -> None:
            nonlocal tried
            tried += 1
            if self.channel is None:
                self.channel = self.outlet.channel(self.run, self.batch_id)
            self.channel.send(lines, values)

        try:
            self.outlet.retry.run(attempt)
            self.outcome.delivered += len(lines)
            self.outcome.count(self.reached.mark(rows), 0)
        except RetriesExhausted as error:
            self.outcome.failed += len(lines)
            self.outcome.error = str(error)
            self.outcome.count(self.reached.origins_of(rows), 1)
            if self.dead is not None:
                letters = [
                    json.dumps(
                        {"sink": self.outlet.name, "entry": line, "error": str(error.__cause__), "attempts": tried},
                        ensure_ascii=False,
                    )
                    for line in lines
                ]
                self.dead.send(letters, [])
        self.outcome.attempts += tried

    def finish(self) -> list[Written]:
        if self.lines:
            self._deliver(self.lines, self.values, self.rows)
        return [] if self.channel is None else self.channel.close()


@dataclass
class TaskReport(WriterCommitMessage):
    outcomes: list[Outcome]
    files: list[list[Written]]
    dead: list[list[Written]]
    reached: dict[str, int] = field(default_factory=dict)


def _feed_all(batches: Iterator[pa.RecordBatch], outlets: Sequence[Outlet], run: str, batch_id: int | None) -> TaskReport:
    letters = [
        None if outlet.dead_letters is None else _dead_outlet(outlet).channel(f"{run}-{number}", batch_id)
        for number, outlet in enumerate(outlets)
    ]
    reached = _Reached()
    feeds = [
        _Feed(outlet, f"{run}-{number}", batch_id, dead, reached)
        for number, (outlet, dead) in enumerate(zip(outlets, letters))
    ]
    for batch in batches:
        lines = batch.column("line").to_pylist()
        first = reached.add(batch.column("origin").to_pylist())
        goes = batch.column("goes")
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(goes), 0))
        flat = goes.flatten()
        which = np.asarray(flat.field("outlet"))
        row = np.repeat(np.arange(len(lines)), sizes)
        values = flat.field("folder").to_pylist()
        for number, feed in enumerate(feeds):
            mine = np.flatnonzero(which == number)
            if len(mine):
                of = row[mine].tolist()
                feed.put([lines[at] for at in of], [values[at] for at in mine], [first + at for at in of])
    files = []
    for feed in feeds:
        try:
            files.append(feed.finish())
        except Exception as error:  # noqa: BLE001 - one outlet must not take the others along
            files.append([])
            feed.outcome.all_failed(error)
    dead = [[] if channel is None else channel.close() for channel in letters]
    return TaskReport([feed.outcome for feed in feeds], files, dead, reached.totals())


def _dead_outlet(outlet: Outlet) -> FileOutlet:
    return FileOutlet(f"dead-{outlet.name}", path=outlet.dead_letters or "")


# -- the data source --------------------------------------------------------


def _settle(
    messages: Iterable[TaskReport | None], outlets: Sequence[Outlet], run: str, batch_id: int | None
) -> list[Outcome]:
    """Totals by outlet; files made visible, one outlet after another."""
    totals = [Outcome() for _ in outlets]
    reports = [message for message in messages if message is not None]
    for number, outlet in enumerate(outlets):
        for report in reports:
            totals[number].add(report.outcomes[number])
        try:
            files = [file for report in reports for file in report.files[number]]
            outlet.settle(f"{run}-{number}", files, batch_id)
        except Exception as error:  # noqa: BLE001 - reported, the others go on
            totals[number].all_failed(error)
        if outlet.dead_letters is not None:
            letters = [file for report in reports for file in report.dead[number]]
            if letters or batch_id is not None:
                _dead_outlet(outlet).settle(f"{run}-{number}", letters, batch_id)
    return totals


def _reached_of(messages: Iterable[TaskReport | None]) -> dict[str, int]:
    total: Counter[str] = Counter()
    for message in messages:
        if message is not None:
            total.update(message.reached)
    return dict(total)


def _write_report(
    path: str | None, totals: Sequence[Outcome], outlets: Sequence[Outlet], batch_id: int | None, reached: dict[str, int]
) -> None:
    """A line of JSON per outlet, and one of the entries that reached any."""
    if path is None:
        return
    store, folder = filesystem(path)
    store.create_dir(folder, recursive=True)
    name = "batch.json" if batch_id is None else f"batch-{batch_id}.json"
    lines = [
        json.dumps({"outlet": number, "sink": outlet.name, "batch": batch_id, **vars(total)})
        for number, (outlet, total) in enumerate(zip(outlets, totals))
    ]
    with store.open_output_stream(f"{folder}/_reached-{name}") as out:
        out.write(json.dumps(reached).encode())
    with store.open_output_stream(f"{folder}/{name}") as out:
        out.write(("\n".join(lines) + "\n").encode())


class _Writer(DataSourceArrowWriter):
    def __init__(self, outlets: Sequence[Outlet], run: str, report: str | None, batch_id: int | None) -> None:
        self.outlets, self.run, self.report, self.batch_id = list(outlets), run, report, batch_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskReport:
        return _feed_all(iterator, self.outlets, self.run, self.batch_id)

    def commit(self, messages: list) -> None:
        totals = _settle(messages, self.outlets, self.run, self.batch_id)
        _write_report(self.report, totals, self.outlets, self.batch_id, _reached_of(messages))

    def abort(self, messages: list) -> None:
        _discard_all(self.outlets, self.run, self.batch_id)


class _StreamWriter(DataSourceStreamArrowWriter):
    """A task does not know its micro-batch; the commit does, and files are moved
    to that batch's folder there."""

    def __init__(self, outlets: Sequence[Outlet], run: str, report: str | None) -> None:
        self.outlets, self.run, self.report = list(outlets), run, report

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskReport:
        return _feed_all(iterator, self.outlets, self.run, None)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - Spark's name
        totals = _settle(messages, self.outlets, self.run, batchId)
        _write_report(self.report, totals, self.outlets, batchId, _reached_of(messages))
        failed = [(o, t) for o, t in zip(self.outlets, totals) if t.failed and o.dead_letters is None]
        if failed:
            # the query stops; its next start replays the batch
            raise RuntimeError("; ".join(failure_text(o, t) for o, t in failed))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _discard_all(self.outlets, self.run, batchId)


def _discard_all(outlets: Sequence[Outlet], run: str, batch_id: int | None) -> None:
    for number, outlet in enumerate(outlets):
        outlet.discard(f"{run}-{number}", batch_id)
        if outlet.dead_letters is not None:
            _dead_outlet(outlet).discard(f"{run}-{number}", batch_id)


class OutletSource(DataSource):
    """Rows of ``line``, ``origin`` and ``goes``, for the outlets packed into an option."""

    @classmethod
    def name(cls) -> str:
        return "riverlog_outlets"

    def schema(self) -> str:
        return "line string, origin string, goes array<struct<outlet int, folder array<string>>>"

    def _outlets(self) -> list[Outlet]:
        return cloudpickle.loads(base64.b64decode(self.options["outlets"]))

    def writer(self, schema, overwrite: bool) -> _Writer:
        batch = self.options.get("batch")
        return _Writer(
            self._outlets(), self.options["run"], self.options.get("report"), None if batch is None else int(batch)
        )

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(self._outlets(), self.options["run"], self.options.get("report"))


@dataclass(frozen=True)
class Branch:
    """An outlet and which entries it gets."""

    outlet: Outlet
    condition: Column | None = None


def addressed(entries: DataFrame, branches: Sequence[Branch]) -> DataFrame:
    """One line per entry, and the outlets it goes to; entries for none are gone."""
    goes = []
    for number, branch in enumerate(branches):
        names = getattr(branch.outlet, "partition_by", ())
        folder = F.array(*[F.col(name).cast("string") for name in names]).cast("array<string>")
        item = F.struct(F.lit(number).alias("outlet"), folder.alias("folder"))
        goes.append(item if branch.condition is None else F.when(branch.condition, item))
    found = F.filter(F.array(*goes), lambda item: item.isNotNull())
    origin = F.col(ORIGIN if ORIGIN in entries.columns else "source")
    rows = entries.select(entry_json().alias("line"), origin.alias("origin"), found.alias("goes"))
    return rows if any(b.condition is None for b in branches) else rows.where(F.size("goes") > 0)


@dataclass(frozen=True)
class Delivery:
    """What became of a set of entries: totals by branch, and how many entries of
    each origin reached at least one sink."""

    outcomes: list[Outcome]
    reached: dict[str, int]


def deliver(entries: DataFrame, branches: Sequence[Branch], batch_id: int | None = None) -> Delivery:
    """Give entries to all branches in one job."""
    require(len(branches) > 0, "deliver: at least one outlet is needed")
    spark = entries.sparkSession
    spark.dataSource.register(OutletSource)
    outlets = [_placed(spark, branch.outlet) for branch in branches]
    report = qualified(spark, scratch_path(spark, "delivery-report"))
    writer = (
        addressed(entries, branches)
        .write.format(OutletSource.name())
        .mode("append")
        .option("outlets", base64.b64encode(cloudpickle.dumps(outlets)).decode())
        .option("run", uuid.uuid4().hex)
        .option("report", report)
    )
    if batch_id is not None:
        writer = writer.option("batch", str(batch_id))
    writer.save()
    store, folder = filesystem(report)
    name = "batch.json" if batch_id is None else f"batch-{batch_id}.json"
    with store.open_input_file(f"{folder}/{name}") as file:
        rows = [json.loads(line) for line in file.read().decode().splitlines()]
    with store.open_input_file(f"{folder}/_reached-{name}") as file:
        reached = json.loads(file.read())
    parts = [item.name for item in fields(Outcome)]
    return Delivery([Outcome(**{part: row[part] for part in parts}) for row in rows], reached)


def _placed(spark: SparkSession, outlet: Outlet) -> Outlet:
    if outlet.dead_letters is not None:
        outlet = replace(outlet, dead_letters=qualified(spark, outlet.dead_letters))
    if isinstance(outlet, FileOutlet):
        outlet = replace(outlet, path=qualified(spark, outlet.path))
    return outlet


def failure_text(outlet: Outlet, outcome: Outcome) -> str:
    total = outcome.delivered + outcome.failed
    return f"{outlet.name}: {outcome.failed} of {total} entries failed: {outcome.error}"


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Undelivered entries with the sink, its last error and the attempts made."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.from_json("value", DEAD_LETTER).alias("letter")).select("letter.*")
