"""Growing log files as a stream of lines.

Spark's own file source never reads a file twice, so it cannot follow a file
that is appended to.  This data source can: its offset is, per file, the inode
and the byte up to which whole lines were consumed, kept in the query's
checkpoint.  A batch is a set of byte ranges read in parallel by the executors,
which must see the files under the same paths (a shared mount).

* A batch holds the lines whose line break lies in its bytes; an unfinished line
  waits, and is read from its start when its end has come.  The driver takes sizes
  only (a few at a time in parallel); tasks find where lines begin and end.
* ``max_bytes`` bounds what a batch reads.  It is dealt in turns: files with
  something to read are served in the order of their names, from where the last
  batch stopped, at least ``QUANTUM`` bytes each, and what is left once more.  The
  place in the round is part of the offset, so no file starves.  Spark does not
  tell a source its place when a query restarts, so tails note it in the file
  ``places`` as they plan a batch: name one from the first start of a query on.
  Without one the first batch after a restart is not bounded.  Small pieces of
  many files share a task.
* A file that was replaced (other inode) or has shrunk restarts at byte 0; one
  that was renamed under the pattern goes on where it was.
* A file missing from a listing keeps its place for ``KEEP_POLLS`` polls.
* A range is read from the inode it was planned for, also after a rename inside
  the folder; if that file is gone the batch fails and says so.
* ``start="latest"`` skips what is in the files when the query first starts.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from riverlog.model import require
from riverlog.plans.storage import filesystem

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
KEEP_POLLS = 100_000
# The least that a file with a backlog is served in its turn.
QUANTUM = 64 << 10
STAT_THREADS = 16

_SCHEMA = "value string, file string, pos bigint"
_ARROW = pa.schema([("value", pa.string()), ("file", pa.string()), ("pos", pa.int64())])


@dataclass
class ByteRange(InputPartition):
    """Lines of ``path`` that start in ``[first, end)``, where ``floor`` starts a
    line; or, if ``ended``, lines whose line break lies in ``[first, end)``."""

    path: str
    floor: int
    first: int
    end: int
    inode: int | None = None
    ended: bool = False


@dataclass
class RangeGroup(InputPartition):
    """Small ranges that one task reads."""

    ranges: list[ByteRange]


def split_ranges(
    path: str, start: int, end: int, size: int, inode: int | None = None, ended: bool = False
) -> list[ByteRange]:
    return [ByteRange(path, start, at, min(at + size, end), inode, ended) for at in range(start, end, size)]


def grouped(ranges: Sequence[ByteRange], size: int) -> list[InputPartition]:
    """Ranges as tasks of up to ``size`` bytes."""
    groups: list[list[ByteRange]] = []
    held = 0
    for part in ranges:
        length = part.end - part.first
        if not groups or held + length > size:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += length
    return [group[0] if len(group) == 1 else RangeGroup(group) for group in groups]


def dealt(backlog: dict[str, int], budget: int, turn: str) -> tuple[dict[str, int], str]:
    """How many bytes of each file a batch reads, and whose turn is next.

    Files are served from ``turn`` on, in the order of their names and round again:
    an equal share each, or ``QUANTUM`` if that is more; what the short ones leave
    goes round once more."""
    waiting = sorted(path for path, size in backlog.items() if size > 0)
    first = next((at for at, path in enumerate(waiting) if path >= turn), 0)
    waiting = waiting[first:] + waiting[:first]
    given = dict.fromkeys(waiting, 0)
    left = budget
    while waiting and left > 0:
        share = max(QUANTUM, left // len(waiting))
        for at, path in enumerate(waiting):
            if left <= 0:
                return {p: n for p, n in given.items() if n}, path
            piece = min(share, backlog[path] - given[path], left)
            given[path] += piece
            left -= piece
        waiting = [path for path in waiting if given[path] < backlog[path]]
    return {p: n for p, n in given.items() if n}, waiting[0] if waiting else turn


def last_line_end(path: str, size: int) -> int:
    """The byte after the last line break before ``size``, read backwards."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            begin = max(0, end - BLOCK_BYTES)
            file.seek(begin)
            found = file.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


def _opened(part: ByteRange) -> BinaryIO:
    """The file the range was planned for, wherever in its folder it is by now."""
    if part.inode is None:
        return open(part.path, "rb")
    folder = os.scandir(os.path.dirname(part.path) or ".")
    renamed = (entry.path for entry in folder if entry.inode() == part.inode)
    for path in itertools.chain([part.path], renamed):
        try:
            file = open(path, "rb")
        except OSError:
            continue
        if os.fstat(file.fileno()).st_ino == part.inode:
            return file
        file.close()
    raise FileNotFoundError(f"{part.path}: replaced before bytes {part.first} to {part.end} were read")


def _text(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode("utf-8", "replace")


def _line_start(file: BinaryIO, at: int) -> int:
    """The start of the line that holds byte ``at``."""
    while at > 0:
        begin = max(0, at - BLOCK_BYTES)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def _read_ended(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Lines whose line break lies in the range."""
    with _opened(part) as file:
        position, held = None, []
        at = part.first
        while at < part.end:
            file.seek(at)
            block = file.read(min(BATCH_BYTES, part.end - at))
            if not block:
                return
            at += len(block)
            stop = block.rfind(b"\n") + 1
            if stop and position is None:
                # only now is it known that the line before the range ends in it
                position = _line_start(file, part.first)
                file.seek(position)
                held = [file.read(part.first - position), *held]
            if not stop:
                held.append(block)
                continue
            data = b"".join([*held, block[:stop]])
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            starts = position + np.append(0, ends[:-1])
            yield _batch(part.path, [_text(line) for line in data.split(b"\n")[:-1]], starts)
            position += len(data)
            held = [block[stop:]]


def read_range(part: ByteRange | RangeGroup) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the lines of one range, read block by block."""
    if isinstance(part, RangeGroup):
        for one in part.ranges:
            yield from read_range(one)
        return
    if part.ended:
        yield from _read_ended(part)
        return
    with _opened(part) as file:
        position = part.first
        if position > part.floor:
            file.seek(position - 1)
            position += len(file.readline()) - 1
        else:
            file.seek(position)
        held: list[bytes] = []  # of a line whose end is not read yet
        while position < part.end:
            block = file.read(BATCH_BYTES)
            stop = block.rfind(b"\n") + 1
            if block and stop == 0:
                held.append(block)
                continue
            data = b"".join([*held, block[:stop]])
            if not block:
                if data:
                    yield _batch(part.path, [_text(data)], [position])
                return
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            starts = position + np.append(0, ends[:-1])
            inside = int(np.searchsorted(starts, part.end))
            yield _batch(part.path, [_text(line) for line in data.split(b"\n", inside)[:inside]], starts[:inside])
            position += len(data)
            held = [block[stop:]]


def _batch(path: str, values: list[str], places: Sequence[int] | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, pa.string()), pa.array([path] * len(values), pa.string()), pa.array(places, pa.int64())],
        schema=_ARROW,
    )


def _mounted(path: str) -> str:
    """A plain path; object stores have no growing files to follow."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    require("://" not in path, f"{path}: byte positions need files on a mounted file system")
    return path


def _expand(options: dict) -> list[str]:
    found: set[str] = set()
    for pattern in json.loads(options["paths"]):
        found.update(path for path in glob.glob(pattern) if os.path.isfile(path))
    return sorted(found)


class LineFiles(DataSource):
    """The data source ``line_files``: batch scan and stream over the same files."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    @staticmethod
    def encode(
        paths: Sequence[str],
        start: str = "earliest",
        range_bytes: int = RANGE_BYTES,
        frozen: bool = False,
        max_bytes: int | None = None,
        places: str | None = None,
    ) -> dict[str, str]:
        """Options of the source.  ``frozen`` fixes the files and the ends of their
        whole lines now: every run of the plan then reads the same bytes."""
        mounted = [_mounted(path) for path in paths]
        options = {"paths": json.dumps(mounted), "start": start, "rangeBytes": str(range_bytes)}
        if max_bytes is not None:
            require(max_bytes > 0, f"tail: the bytes of a batch must be above zero, got {max_bytes}")
            options["maxBytes"] = str(max_bytes)
        if places is not None:
            options["places"] = places
        if frozen:
            found = _expand(options)
            options["ends"] = json.dumps({path: last_line_end(path, os.path.getsize(path)) for path in found})
        return options

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(dict(self.options))


def _range_bytes(options: dict) -> int:
    lowered = {key.lower(): value for key, value in options.items()}
    return int(lowered.get("rangebytes", RANGE_BYTES))


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        frozen = self.options.get("ends")
        ends = json.loads(frozen) if frozen else {path: os.path.getsize(path) for path in _expand(self.options)}
        ranges: list[ByteRange] = []
        for path, end in ends.items():
            ranges += split_ranges(path, 0, end, _range_bytes(self.options))
        return ranges

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.ends: dict[str, list[int]] = {}  # newest known, of missing files too
        self.missed: dict[str, int] = {}  # polls in a row without the file
        self.begun: dict[str, list[int]] = {}  # up to where batches were planned
        self.begins: dict[str, list[int]] | None = None  # of a new query
        self.turn = ""  # whose turn it is when a batch is bounded
        self.served: dict[str, list[int]] | None = None  # up to where bounded batches go
        lowered = {key.lower(): value for key, value in options.items()}
        self.budget = int(lowered["maxbytes"]) if lowered.get("maxbytes") else None

    def _ends(self) -> dict[str, list[int]]:
        """Inode and size of every file, and the places of files that are missing."""

        def status(path: str) -> os.stat_result | None:
            try:
                return os.stat(path)
            except OSError:
                return None  # vanished between listing and now; next time

        paths = _expand(self.options)
        with ThreadPoolExecutor(STAT_THREADS) as pool:
            found = zip(paths, pool.map(status, paths))
            ends = {path: [stat.st_ino, stat.st_size] for path, stat in found if stat is not None}
        present = {inode for inode, _ in ends.values()}
        for path, place in self.ends.items():
            if path not in ends and place[0] not in present and self.missed.get(path, 0) < KEEP_POLLS:
                ends[path] = place
                self.missed[path] = self.missed.get(path, 0) + 1
            else:
                self.missed.pop(path, None)
        self.ends = ends
        return dict(ends)

    def initialOffset(self) -> dict:
        if self.begins is None:
            self.begins = self._ends() if self.options.get("start") == "latest" else {}
        if self.served is None:
            self.served = dict(self.begins)
        return {"files": dict(self.begins)}

    def latestOffset(self) -> dict:
        ends = self._ends()
        if self.begins is None and self.options.get("start") == "latest":
            # a run to the end of what is there asks for that end first
            self.begins = dict(ends)
        if self.budget is None:
            return {"files": ends}
        return self._bounded(ends)

    def _bounded(self, ends: dict[str, list[int]]) -> dict:
        """The ends of a batch of at most ``budget`` bytes behind the last one."""
        if self.served is None and not self._recall():
            if not self.options.get("places"):
                return {"files": ends}  # where a restarted query is, is not known
            self.begins = dict(ends) if self.options.get("start") == "latest" else {}
            self.served = dict(self.begins)
        served = self.served
        by_inode = {inode: stop for inode, stop in sorted(served.values())}
        begins: dict[str, int] = {}
        for path, (inode, size) in ends.items():
            old_inode, begin = served.get(path, (None, 0))
            begin = begin if old_inode == inode else by_inode.get(inode, 0)
            begins[path] = 0 if size < begin else begin
        backlog = {path: ends[path][1] - begin for path, begin in begins.items()}
        given, turn = dealt(backlog, self.budget, self.turn)
        files = {path: [ends[path][0], begin + given.get(path, 0)] for path, begin in begins.items()}
        self.served, self.turn = files, turn
        return {"files": dict(files), "turn": turn}

    def _recall(self) -> bool:
        """The end of the last batch that was planned, after a restart."""
        if not self.options.get("places"):
            return False
        store, path = filesystem(self.options["places"])
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return False
        with store.open_input_file(path) as file:
            end = json.loads(file.read())
        self.served, self.turn = end["files"], end.get("turn", "")
        return True

    def _note(self, end: dict) -> None:
        if self.options.get("places"):
            store, path = filesystem(self.options["places"])
            folder = path.rpartition("/")[0]
            if folder:
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{path}.next") as out:
                out.write(json.dumps(end).encode())
            store.move(f"{path}.next", path)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # after a restart only the start tells of files the first listing missed
        self.begun.update(start["files"])
        if self.served is None:  # after a restart: bounded batches go on from here
            self.served, self.turn = dict(end["files"]), end.get("turn", "")
        self._note(end)
        self.ends = start["files"] | self.ends
        by_inode = {inode: stop for inode, stop in sorted(self.begun.values())}
        ranges: list[ByteRange] = []
        for path, (inode, stop) in end["files"].items():
            old_inode, begin = self.begun.get(path, (None, 0))
            if old_inode != inode:
                begin = by_inode.get(inode, 0)
            if stop < begin:
                begin = 0
            ranges += split_ranges(path, begin, stop, _range_bytes(self.options), inode, ended=True)
        self.begun = {path: place for path, place in self.begun.items() if path in self.ends}
        return grouped(ranges, _range_bytes(self.options))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


def tail_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    label: str | None = None,
    start: str = "latest",
    range_bytes: int = RANGE_BYTES,
    max_bytes: int | None = None,
    places: str | None = None,
) -> DataFrame:
    """A stream of ``value``, ``source``, ``file`` and ``pos``.  The trigger of
    the query is the poll interval.  ``max_bytes`` bounds a micro-batch; a query
    that runs once (``availableNow``) then reads one such batch.  ``places`` is a
    file of this query's own, best in its checkpoint folder."""
    require(start in ("latest", "earliest"), f"tail: start must be latest or earliest, got {start!r}")
    wanted = [paths] if isinstance(paths, str) else list(paths)
    spark.dataSource.register(LineFiles)
    options = LineFiles.encode(wanted, start, range_bytes, max_bytes=max_bytes, places=places)
    lines = spark.readStream.format(LineFiles.name()).options(**options).load()
    return lines.select(
        "value", (F.col("file") if label is None else F.lit(label)).alias("source"), "file", "pos"
    )
