"""Stateful operators on streams.

Stateless operators (parse, filter, rewrite, route...) are plain projections and
run on streams as they are.  The ones here keep a small state per key, with the
same meaning as their batch forms when rows arrive in order:

* rows of one key are ordered inside each micro-batch;
* without a ``watermark`` no row is ever late and state is kept for good;
* with one (a delay such as "10 minutes") Spark drops rows later than that and
  state that can no longer matter is removed.

Entries cross into Python as Arrow batches; ``fields`` travels as JSON text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riverlog.functions.timestamps import micros
from riverlog.functions.values import empty_fields
from riverlog.model import FIELDS, require
from riverlog.operators.batching import check_batching, fold_batches
from riverlog.operators.buffer import check_capacity, keep_latest
from riverlog.operators.multiline import check_multiline, is_continuation, line_text, set_text
from riverlog.operators.observe import AVAILABLE, INODE_CHANGED, MISSING, TRUNCATED

# Microseconds to the farthest times that pandas knows, nearly.
_FAR = 9_200_000_000_000_000

_FIELDS_TYPE = "map<string,variant>"
_ROW_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# step(sorted rows, old state or None) -> (rows out, new state, expiry in ms or None)
Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple, int | None]]


def _stateful(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    state: str,
    step: Step,
    extra: Sequence[T.StructField] = (),
    drop: Sequence[str] = (),
    on_timeout: Callable[[tuple], pd.DataFrame] | None = None,
    watermark: tuple[str, str] | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    has_fields = FIELDS in df.columns
    if watermark is not None:
        df = df.withWatermark(*watermark)
    if has_fields:
        df = df.withColumn(FIELDS, F.to_json(FIELDS))
    kept = [item for item in df.schema.fields if item.name not in drop]
    names = [item.name for item in kept] + [item.name for item in extra]
    schema = T.StructType([*kept, *extra])
    if watermark is not None:
        timeout = GroupStateTimeout.EventTimeTimeout
    elif idle_ms is not None:
        timeout = GroupStateTimeout.ProcessingTimeTimeout
    else:
        timeout = GroupStateTimeout.NoTimeout

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        old = group.get if group.exists else None
        if group.hasTimedOut:
            group.remove()
            if on_timeout is not None and old is not None:
                yield on_timeout(old)[names]
            return
        rows = pd.concat(list(chunks), ignore_index=True)
        rows = rows.sort_values(list(order), kind="stable", ignore_index=True)
        out, new, expiry = step(rows, old)
        group.update(new)
        if watermark is not None and expiry is not None:
            group.setTimeoutTimestamp(max(expiry, group.getCurrentWatermarkMs() + 1))
        elif idle_ms is not None:
            group.setTimeoutDuration(idle_ms)
        yield out[names]

    result = df.groupBy(*by).applyInPandasWithState(advance, schema, state, "append", timeout)
    if has_fields:
        parsed = F.coalesce(F.from_json(FIELDS, _FIELDS_TYPE), empty_fields())
        result = result.withColumn(FIELDS, parsed)
    return result


def _at(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_at", micros(F.col(ts), df.schema[ts].dataType.simpleString()))


def _mark(ts: str, watermark: str | None) -> tuple[str, str] | None:
    return None if watermark is None else (ts, watermark)


def dedup_stream(
    df: DataFrame,
    window: float,
    key: str = "raw",
    ts: str = "timestamp",
    order: Sequence[str] = (),
    watermark: str | None = None,
) -> DataFrame:
    """Streaming form of ``dedup_window``: the first of a burst is emitted at
    once, state is the time a line was last seen."""
    width = round(window * 1_000_000)
    require(width > 0, "dedup: the window must be above zero seconds")
    keyed = _at(df, ts).withColumn("_key", F.sha2(F.col(key), 256))

    def step(rows: pd.DataFrame, old: tuple | None):
        at = rows["_at"].to_numpy(dtype=np.int64)
        seen = np.maximum.accumulate(at if old is None else np.maximum(at, old[0]))
        first = np.iinfo(np.int64).min if old is None else old[0]
        before = np.concatenate(([first], seen[:-1]))
        fresh = at - np.maximum(before, at - 2 * width) >= width
        return rows[fresh], (int(seen[-1]),), (int(seen[-1]) + width) // 1000 + 1

    return _stateful(
        keyed, ["_key"], [ts, *order], "last bigint", step, drop=["_at", "_key"], watermark=_mark(ts, watermark)
    )


def multiline_stream(
    df: DataFrame,
    field: str,
    prefixes: Sequence[str],
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    ts: str = "timestamp",
    flush_after: float | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Streaming form of ``coalesce_multiline``.  The open record of a source is
    emitted when the next one starts, or after ``flush_after`` seconds of
    silence if given: of event time with a watermark, of processing time without.
    A processing-time timer keeps a query running, so an ``availableNow`` query
    should use a watermark or no timer."""
    check_multiline(field, prefixes)
    silence = None if flush_after is None else round(flush_after * 1000)
    text = line_text(field)
    # Of an open record only its first row, as JSON text, and its lines are kept.
    lines = _at(df, ts).select(
        *by,
        *[name for name in dict.fromkeys([*order, ts]) if name not in by],
        "_at",
        F.to_json(F.struct(*df.columns), _ROW_JSON).alias("_row"),
        text.alias("_text"),
        is_continuation(text, prefixes).alias("_more"),
    )

    def step(rows: pd.DataFrame, old: tuple | None):
        texts = rows["_text"].tolist()
        heads = rows["_row"].tolist()
        more = rows["_more"].tolist()
        closed: list[tuple[str, str]] = []
        head, body = (None, []) if old is None else (old[0], list(old[1]))
        for row, value, continues in zip(heads, texts, more, strict=True):
            if head is not None and continues:
                body.append(value)
                continue
            if head is not None:
                closed.append((head, "\n".join(body)))
            head, body = row, [value]
        out = pd.DataFrame(closed, columns=["_row", "_joined"])
        expiry = None if silence is None else int(rows["_at"].iloc[-1]) // 1000 + silence
        return out, (head, body), expiry

    def on_timeout(old: tuple) -> pd.DataFrame:
        return pd.DataFrame([(old[0], "\n".join(old[1]))], columns=["_row", "_joined"])

    records = _stateful(
        lines,
        by,
        order,
        "head string, body array<string>",
        step,
        extra=[T.StructField("_joined", T.StringType())],
        drop=[name for name in lines.columns if name != "_row"],
        on_timeout=on_timeout,
        watermark=_mark(ts, watermark),
        idle_ms=silence,
    )
    row = F.from_json("_row", df.schema, _ROW_JSON)
    restored = records.select(row.alias("_row"), "_joined").select("_row.*", "_joined")
    return set_text(restored, field, F.col("_joined")).drop("_joined")


def batch_stream(
    df: DataFrame,
    max_size: int,
    interval: float,
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    ts: str = "timestamp",
) -> DataFrame:
    """Streaming form of ``assign_batches``.  An entry's batch is known when it
    arrives, so nothing is held back: state is tick, fill and batch number."""
    check_batching(max_size, interval)
    step_us = round(interval * 1_000_000)

    def step(rows: pd.DataFrame, old: tuple | None):
        at = rows["_at"].to_numpy(dtype=np.int64)
        deadline, held, closed = (int(at[0]) + step_us, 0, 0) if old is None else old
        numbers, closes, deadline, held = fold_batches(at, max_size, step_us, deadline, held)
        return rows.assign(batch_id=numbers + closed + 1), (int(deadline), int(held), int(closed + closes)), None

    return _stateful(
        _at(df, ts),
        by,
        order,
        "deadline bigint, held bigint, closed bigint",
        step,
        extra=[T.StructField("batch_id", T.LongType())],
        drop=["_at"],
    )


def keep_latest_batch(
    capacity: int, by: Sequence[str] = ("source",), order: Sequence[str] = ("timestamp",)
) -> Callable[[DataFrame], DataFrame]:
    """Buffering in a stream: one flush per micro-batch.  Use as the operator of
    a transformed sink, inside ``foreachBatch``."""
    check_capacity(capacity)
    return lambda entries: keep_latest(entries, capacity, by, order).drop("buffer_pos")


def _whole(df: DataFrame, name: str) -> Column:
    """A column to sort by; times as whole numbers, of any year."""
    kind = df.schema[name].dataType
    return micros(F.col(name), kind.simpleString()) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else F.col(name)


def keep_latest_stream(
    df: DataFrame,
    capacity: int,
    period: float,
    by: Sequence[str] = ("source",),
    order: Sequence[str] = ("timestamp",),
    ts: str = "timestamp",
    lateness: float = 0.0,
) -> DataFrame:
    """Streaming form of ``keep_latest`` with a flush period: per key and period
    the newest ``capacity`` entries, emitted with ``buffer_pos`` when the period
    is over in event time.

    State is the best ``capacity`` rows of each open period.  A period ends, and
    entries of it are late and dropped, once entries of a later one have come and
    ``lateness`` seconds of event time have passed on top."""
    check_capacity(capacity)
    width = round(period * 1_000_000)
    require(width > 0, "keep_latest: the period must be above zero seconds")
    require(lateness >= 0, "keep_latest: the lateness must not be negative")
    timed = _at(df, ts).withColumn("_period", F.col("_at") - F.pmod("_at", F.lit(width)) + width)
    names = [f"_place_{number}" for number in range(len(order))]
    rows = timed.select(
        *by,
        *[_whole(df, name).alias(place) for name, place in zip(order, names)],
        F.to_json(F.struct(*df.columns), _ROW_JSON).alias("_row"),
        "_period",
        # the end of its period is the event time of a row: none is late before
        F.timestamp_micros(F.greatest(F.lit(-_FAR), F.least("_period", F.lit(_FAR)))).alias("_flush_at"),
    )

    def step(rows: pd.DataFrame, old: tuple | None):
        held = [] if old is None else pickle.loads(old[0])
        places = zip(*(rows[name] for name in names))
        held += [([(not pd.isna(v), v) for v in place], row) for place, row in zip(places, rows["_row"])]
        held.sort(key=lambda item: item[0])
        expiry = int(rows["_flush_at"].iloc[0].value) // 1_000_000
        empty = rows.iloc[:0].assign(buffer_pos=pd.Series(dtype="int64"))
        return empty, (pickle.dumps(held[-capacity:]),), expiry

    def on_timeout(old: tuple) -> pd.DataFrame:
        held = pickle.loads(old[0])
        return pd.DataFrame({"_row": [row for _, row in held], "buffer_pos": range(1, len(held) + 1)})

    kept = _stateful(
        rows,
        [*by, "_period", "_flush_at"],
        names,
        "held binary",
        step,
        extra=[T.StructField("buffer_pos", T.LongType())],
        drop=[name for name in rows.columns if name != "_row"],
        on_timeout=on_timeout,
        watermark=("_flush_at", f"{round(lateness * 1000)} milliseconds"),
    )
    row = F.from_json("_row", df.schema, _ROW_JSON)
    return kept.select(row.alias("_row"), "buffer_pos").select("_row.*", "buffer_pos")


def transitions_stream(
    polls: DataFrame,
    by: Sequence[str] = ("path",),
    order: Sequence[str] = ("poll_ts",),
    available: str = "available",
) -> DataFrame:
    """Streaming form of ``state_transitions``."""
    seen = polls.withColumn("state", F.when(F.col(available), AVAILABLE).otherwise(MISSING))

    def step(rows: pd.DataFrame, old: tuple | None):
        state = rows["state"]
        before = state.shift(1)
        before.iloc[0] = None if old is None else old[0]
        return rows[state != before], (state.iloc[-1],), None

    return _stateful(seen, by, order, "state string", step)


def rotation_stream(
    polls: DataFrame,
    by: Sequence[str] = ("path",),
    order: Sequence[str] = ("poll_ts",),
    inode: str = "inode",
    size: str = "size",
) -> DataFrame:
    """Streaming form of ``rotation_events``."""
    found = polls.where(F.col(inode).isNotNull() & F.col(size).isNotNull())

    def step(rows: pd.DataFrame, old: tuple | None):
        inodes, sizes = rows[inode].to_numpy(dtype=np.int64), rows[size].to_numpy(dtype=np.int64)
        base = (inodes[0], sizes[0]) if old is None else old
        inode_before = np.concatenate(([base[0]], inodes[:-1]))
        size_before = np.concatenate(([base[1]], sizes[:-1]))
        reason = np.where(
            inodes != inode_before, INODE_CHANGED, np.where(sizes < size_before, TRUNCATED, "")
        )
        out = rows.assign(reason=reason)
        return out[reason != ""], (int(inodes[-1]), int(sizes[-1])), None

    return _stateful(
        found,
        by,
        order,
        "inode bigint, size bigint",
        step,
        extra=[T.StructField("reason", T.StringType())],
    )
