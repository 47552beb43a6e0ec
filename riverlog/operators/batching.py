"""Size- and time-bounded batches.

A batch closes when it holds ``max_size`` entries or when ``interval`` has
passed since the last close, whichever comes first; the clock restarts at a
close by size and ticks on otherwise, also while nothing arrives.

By size alone a batch is arithmetic on the row number.  With the clock it is a
true left-to-right fold whose state is ``(deadline, held)``: the next tick and
the entries in the open batch.  The chunks of a key are folded in parallel from
guessed states; chunks whose guess differs from what the chunk before left are
folded again until all agree, which makes the result the sequential one whatever
the guesses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverlog.functions.timestamps import micros
from riverlog.model import require
from riverlog.plans.ordered import RowNumber, cut_rows, with_running


def check_batching(max_size: int, interval: float | None) -> None:
    require(max_size >= 1, f"batch: the size must be at least 1, got {max_size}")
    require(interval is None or interval > 0, "batch: the interval must be above zero seconds")


def fold_batches(
    times: np.ndarray, max_size: int, interval: int, deadline: int, held: int
) -> tuple[np.ndarray, int, int, int]:
    """Local batch number of each arrival (0 = the batch open on entry), the
    number of closes, and the state left.  Steps once per batch, not per row."""
    numbers = np.empty(len(times), dtype=np.int64)
    closes = 0
    at = 0
    while at < len(times):
        now = int(times[at])
        if now >= deadline:
            closes += held > 0
            held = 0
            deadline += ((now - deadline) // interval + 1) * interval
        due = int(np.searchsorted(times, deadline, side="left"))
        end = min(due, at + max_size - held)
        numbers[at:end] = closes
        held += end - at
        at = end
        if held == max_size:
            closes += 1
            held = 0
            deadline = int(times[at - 1]) + interval
    return numbers, closes, deadline, held


def assign_batches(
    df: DataFrame,
    max_size: int,
    interval: float | None = None,
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    ts: str = "timestamp",
    start: Column | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``batch_id``, counted from 1 per key.  ``interval`` is in seconds.

    ``start`` is when the clock of a key was set; default: its first entry.
    ``order`` must rise with ``ts``; rows that tie in it are interchangeable, and
    each keeps one batch of its own.
    """
    check_batching(max_size, interval)
    if interval is None:
        numbered = with_running(df, by, order, [RowNumber("_i")], chunks)
        batch = F.floor((F.col("_i") - 1) / max_size) + 1
        return numbered.withColumn("batch_id", batch).drop("_i")

    step = round(interval * 1_000_000)
    at = micros(F.col(ts), df.schema[ts].dataType.simpleString())
    begin = F.lit(None).cast("bigint") if start is None else F.unix_micros(start)
    place = [*by, *[name for name in order if name not in by]]
    cut = cut_rows(df.withColumns({"_at": at, "_begin": begin}), by, order, ["_at", "_begin"], chunks)
    rows = cut.chunk(cut.narrow).drop("_key_of_chunk")
    df = cut.rows.select(*df.columns)
    cut = _with_states(rows, by, max_size, step)
    batches = _number_rows(cut, by, order, max_size, step)
    # rows of one place are interchangeable: each takes one of the place's batch numbers
    tied = df.withColumn("_tie", F.row_number().over(W.partitionBy(*place).orderBy(*place)))
    batches = batches.withColumn("_tie", F.row_number().over(W.partitionBy(*place).orderBy("batch_id")))
    match = tied["_tie"] == batches["_tie"]
    for name in place:
        match = match & tied[name].eqNullSafe(batches[name])
    return tied.join(batches, match).select(*[tied[name] for name in df.columns], batches["batch_id"])


def _number_rows(
    cut: DataFrame, by: Sequence[str], order: Sequence[str], max_size: int, step: int
) -> DataFrame:
    place = [*by, *[name for name in order if name not in by]]
    schema = T.StructType(
        [cut.schema[name] for name in place] + [T.StructField("batch_id", T.LongType())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(max_size, step)
        for batch in batches:
            numbers = pa.array(fold.feed(batch), pa.int64())
            kept = [batch.column(name) for name in place]
            yield pa.RecordBatch.from_arrays([*kept, numbers], names=[*place, "batch_id"])

    return _in_order(cut, [*by, "_chunk"], order).mapInArrow(number, schema)


def _in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a group together and sorted, the first of each group marked.  The
    window leaves every partition in this order, so a group is folded as a run
    of Arrow batches and never held whole in Python."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(window) == 1)


class _Fold:
    """Folds runs of sorted rows; groups may span Arrow batches."""

    def __init__(self, max_size: int, step: int):
        self.max_size = max_size
        self.step = step
        self.deadline = self.held = self.base = self.closes = 0

    def begin(self, batch: pa.RecordBatch, at: int, time: int) -> None:
        def value(name: str) -> int | None:
            return batch.column(name)[at].as_py()

        deadline, begin = value("_deadline"), value("_begin")
        if deadline is None:
            deadline = (time if begin is None else begin) + self.step
        self.deadline, self.held = deadline, value("_held")
        self.base, self.closes = value("_offset") + 1, 0

    def segments(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool]]:
        first = batch.column("_first").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first).tolist()
        if not starts or starts[0] > 0:
            starts = [0, *starts]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield start, end, bool(first[start])

    def feed(self, batch: pa.RecordBatch) -> np.ndarray:
        times = batch.column("_at").to_numpy()
        out = np.empty(batch.num_rows, dtype=np.int64)
        for start, end, is_first in self.segments(batch):
            if start == end:
                continue
            if is_first:
                self.begin(batch, start, int(times[start]))
            out[start:end] = self.advance(times[start:end])
        return out

    def advance(self, times: np.ndarray) -> np.ndarray:
        numbers, closes, self.deadline, self.held = fold_batches(
            times, self.max_size, self.step, self.deadline, self.held
        )
        numbers += self.base + self.closes
        self.closes += closes
        return numbers


def _with_states(cut: DataFrame, by: Sequence[str], max_size: int, step: int) -> DataFrame:
    """Add the state each chunk starts from and the batches before it."""
    keys = [*by, "_chunk"]
    hot = cut.select(*keys, "_at", "_begin")

    # Guesses.  A chunk in a busy stretch most likely closes by size only, so
    # what is held follows from the rows before; a quiet one keeps the clock of
    # the first entry.
    chunks = Window.partitionBy(*by).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    sizes = hot.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_at").alias("_from"),
        F.max("_at").alias("_to"),
        F.min("_begin").alias("_begin"),
    )
    origin = F.coalesce("_begin", F.min("_from").over(Window.partitionBy(*by)))
    busy = F.col("_n") * step >= (F.col("_to") - F.col("_from")) * max_size
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    ticks = F.floor((F.col("_from") - F.col("_origin")) / step) + 1
    guesses = (
        sizes.withColumns({"_origin": origin, "_earlier": earlier})
        .withColumns(
            {
                "_first": F.col("_earlier") == 0,
                "_deadline": F.when(F.col("_earlier") == 0, F.col("_origin") + step)
                .when(busy, F.col("_from") + step)
                .otherwise(F.col("_origin") + ticks * step),
                "_held": F.when(busy, F.col("_earlier") % max_size).otherwise(F.lit(0)).cast("bigint"),
            }
        )
        .select(*keys, "_first", "_deadline", "_held")
    )

    schema = T.StructType(
        [cut.schema[name] for name in keys]
        + [T.StructField("_first", T.BooleanType())]
        + [
            T.StructField(name, T.LongType())
            for name in ("_deadline", "_held", "_closes", "_deadline_out", "_held_out")
        ]
    )
    given = [*keys, "_head", "_deadline", "_held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per chunk: the state it started from and the one it left."""
        fold = _Fold(max_size, step)
        head: pa.RecordBatch | None = None

        def finished() -> pa.RecordBatch:
            left = [fold.closes, fold.deadline, fold.held]
            columns = [head.column(name) for name in given]
            columns += [pa.array([value], pa.int64()) for value in left]
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        for batch in batches:
            times = batch.column("_at").to_numpy()
            for start, end, is_first in fold.segments(batch):
                if start == end:
                    continue
                if is_first:
                    if head is not None:
                        yield finished()
                    head = batch.slice(start, 1)
                    fold.begin(batch, start, int(times[start]))
                fold.advance(times[start:end])
        if head is not None:
            yield finished()

    def fold(states: DataFrame) -> DataFrame:
        rows = _match(hot, states.withColumnRenamed("_first", "_head"), keys)
        rows = rows.withColumn("_offset", F.lit(0).cast("bigint"))
        return _in_order(rows, keys, ["_at"]).mapInArrow(run, schema)

    done = fold(guesses).checkpoint()
    while True:
        linked = done.withColumns(
            {
                "_deadline_in": F.lag("_deadline_out").over(chunks),
                "_held_in": F.lag("_held_out").over(chunks),
            }
        )
        agrees = F.col("_first") | (
            (F.col("_deadline") == F.col("_deadline_in")) & (F.col("_held") == F.col("_held_in"))
        )
        linked = linked.withColumn("_agrees", agrees)
        wrong = linked.where(~F.col("_agrees")).select(
            *keys,
            "_first",
            F.col("_deadline_in").alias("_deadline"),
            F.col("_held_in").alias("_held"),
        )
        if wrong.isEmpty():
            break
        # Every round settles at least the first open chunk of each key.
        done = linked.where("_agrees").select(*done.columns).unionByName(fold(wrong)).checkpoint()

    states = done.select(
        *keys,
        "_deadline",
        "_held",
        F.coalesce(F.sum("_closes").over(before), F.lit(0)).alias("_offset"),
    )
    return _match(cut, states, keys)


def _match(rows: DataFrame, states: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = states.withColumnsRenamed({name: f"_state_{i}" for i, name in enumerate(keys)})
    condition = F.lit(True)
    for i, name in enumerate(keys):
        other = F.col(f"_state_{i}")
        condition = condition & (
            (F.col(name) == other) if name == "_chunk" else F.col(name).eqNullSafe(other)
        )
    joined = rows.join(renamed, condition, how)
    return joined.drop(*[f"_state_{i}" for i in range(len(keys))])
