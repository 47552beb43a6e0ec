"""Running values over an arrival order, without putting a hot key in one task.

``row_number``, running sums, running maxima and "previous value" are window
functions partitioned by a key.  A plain window sends each key to one task, and
one log source may well hold a third of all rows.  So all rows are cut along
``(key, order)`` into chunks of about equal size, whatever the keys hold:

* the rows are computed once and written, by column; a range partitioning of the
  key and order columns, and no others, gives the chunk borders;
* windows run inside ``(key, chunk)``; a summary with one row per key and chunk,
  taken from the written key, order and value columns, gives the value carried
  into each chunk; both meet in an equi-join on ``(key, chunk)``, for which the
  rows are already partitioned and sorted.  The rows are shuffled once.

What the rows are made of, such as decoded lines, is thus made once.  Drop what
is not needed before an ordered operator: all columns it is given are written.

Tables of every size and keys of every size take this one plan.  A table has as
many chunks as the session has shuffle partitions, so chunks are sized like the
partitions of any other shuffle.  Borders are whole ``(key, order)`` tuples:
rows that tie in the leading order column are cut too, only rows that tie in all
columns stay together.  The borders, one tuple per chunk, are fetched once and
put into the plan as a literal: every branch and every task retry cuts alike.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverlog.functions.timestamps import micros
from riverlog.model import require
from riverlog.plans.storage import written

_CHUNK = "_chunk"
_KEY = "_key_of_chunk"


@dataclass(frozen=True)
class RowNumber:
    """1-based position of a row within its key."""

    name: str


@dataclass(frozen=True)
class RunningSum:
    name: str
    value: Column


@dataclass(frozen=True)
class RunningMax:
    """Greatest non-null value up to and including the row."""

    name: str
    value: Column


@dataclass(frozen=True)
class Previous:
    """Value of the row before, NULL on the first row of a key."""

    name: str
    value: Column


Running = RowNumber | RunningSum | RunningMax | Previous


@dataclass(frozen=True)
class Cut:
    """Written rows, their key, order and value columns, and how they are cut;
    reusable for the same rows, keys and order."""

    rows: DataFrame
    narrow: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    borders: str
    place_type: str

    def of(self, narrow: DataFrame) -> Cut:
        """The same cut with more value columns."""
        return replace(self, narrow=narrow)

    def chunk(self, df: DataFrame) -> DataFrame:
        """Add the chunk of each row, and its key as one struct: never NULL
        itself, equal when its parts are, NULLs included, so that window and
        join share one partitioning."""
        cut = df.withColumn(_CHUNK, _chunk_index(_place(df, self.by, self.order), self.borders, self.place_type))
        return cut.withColumn(_KEY, F.struct(*self.by)) if self.by else cut


def _distinct(by: Sequence[str], order: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*by, *order]))


def _place(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> Column:
    """Key and order of a row as one tuple, times as whole numbers."""
    parts = []
    for number, name in enumerate(_distinct(by, order)):
        kind = df.schema[name].dataType
        timed = isinstance(kind, T.TimestampType | T.TimestampNTZType)
        part = micros(F.col(name), kind.simpleString()) if timed else F.col(name)
        parts.append(part.alias(f"p{number}"))
    return F.struct(*parts)


def cut_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str] = (), chunks: int | None = None
) -> Cut:
    """Write the rows and cut them into ``chunks`` (default: the shuffle
    partitions of the session) of about equal size."""
    require(len(order) > 0, "an arrival order needs at least one column")
    require(chunks is None or chunks >= 1, "the number of chunks must be at least 1")
    spark = df.sparkSession
    columns = _distinct(by, order)
    rows = written(df, "ordered-rows")
    narrow = rows.select(*columns, *[name for name in values if name not in columns])
    wanted = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = (
        narrow.repartitionByRange(wanted, *columns)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", _place(narrow, by, order))
        .groupBy("_part")
        .agg(F.min("_place").alias("_place"))
    )
    found = firsts.agg(F.to_json(F.array_sort(F.collect_list("_place"))).alias("borders"))
    kind = firsts.schema["_place"].dataType.simpleString()
    return Cut(rows, narrow, tuple(by), tuple(order), found.first()["borders"], kind)


def _chunk_index(place: Column, borders: str, place_type: str) -> Column:
    """How many borders lie at or below ``place``: a binary search in steps of
    falling powers of two over a literal array."""
    count = len(json.loads(borders))
    if count < 2:
        return F.lit(0)
    steps = [2**k for k in reversed(range(count.bit_length()))]
    # A constant: Spark reads the text once, when it plans.
    table = F.from_json(F.lit(borders), f"array<{place_type}>")
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda below, step: below + F.when(F.get(table, below + step - 1) <= place, step).otherwise(0),
    )


def _local(item: Running, window: Window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match item:
        case RowNumber():
            return F.row_number().over(window).cast("bigint")
        case RunningSum():
            return F.sum(item.value).over(upto)
        case RunningMax():
            return F.max(item.value).over(upto)
        case Previous():
            return F.lag(item.value).over(window)


def _summary(item: Running, value: str | None, order: Column) -> Column:
    match item:
        case RowNumber():
            return F.count(F.lit(1))
        case RunningSum():
            return F.sum(value)
        case RunningMax():
            return F.max(value)
        case Previous():
            return F.max_by(F.struct(F.col(value).alias("v")), order)


def _carry(item: Running, column: Column, before: Window, chunks: Window) -> Column:
    match item:
        case RowNumber() | RunningSum():
            return F.sum(column).over(before)
        case RunningMax():
            return F.max(column).over(before)
        case Previous():
            return F.lag(column).over(chunks)


def _combine(item: Running, local: Column, carry: Column, first: Column) -> Column:
    match item:
        case RowNumber() | RunningSum():
            return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
        case RunningMax():
            return F.when(local.isNull() | (carry > local), F.coalesce(carry, local)).otherwise(local)
        case Previous():
            return F.when(first, carry["v"]).otherwise(local)


def with_running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    items: Sequence[Running],
    chunks: int | None = None,
    cut: Cut | None = None,
    keep_chunks: bool = False,
) -> DataFrame:
    """Add one column per item, computed over ``by`` in ascending ``order``.

    ``order`` must be total within a key.  With ``keep_chunks`` the result keeps
    its chunks, and the next call on it with the same ``cut`` needs no new
    shuffle of rows; the values of its items must then be columns of the cut.
    """
    valued = {item.name: f"_value_{n}" for n, item in enumerate(items) if not isinstance(item, RowNumber)}
    values = {valued[item.name]: item.value for item in items if item.name in valued}
    if cut is None:
        columns = df.columns
        cut = cut_rows(df.withColumns(values) if values else df, by, order, list(values), chunks)
        df, narrow = cut.rows.select(*columns), cut.narrow
    else:
        narrow = cut.narrow.withColumns(values) if values else cut.narrow
    narrow = cut.chunk(narrow)
    rows = df if _CHUNK in df.columns else cut.chunk(df)

    keys = [_KEY, _CHUNK] if by else [_CHUNK]
    inside = Window.partitionBy(*keys).orderBy(*[F.col(name).asc() for name in order])
    local_names = {item.name: f"_local_{position}" for position, item in enumerate(items)}
    carry_names = {item.name: f"_carry_{position}" for position, item in enumerate(items)}
    local = rows.withColumns(
        {local_names[item.name]: _local(item, inside) for item in items}
        | {"_first": F.row_number().over(inside) == 1}
    )

    at = F.struct(*order)
    sums = narrow.groupBy(*keys).agg(
        *[_summary(item, valued.get(item.name), at).alias(carry_names[item.name]) for item in items]
    )
    chunks_of = Window.partitionBy(*keys[:-1]).orderBy(_CHUNK)
    before = chunks_of.rowsBetween(Window.unboundedPreceding, -1)
    carries = sums.select(
        *[F.col(name).alias(f"_key_{position}") for position, name in enumerate(keys)],
        *[
            _carry(item, F.col(carry_names[item.name]), before, chunks_of).alias(carry_names[item.name])
            for item in items
        ],
    )
    match_keys = F.lit(True)
    for position, name in enumerate(keys):
        match_keys = match_keys & (F.col(name) == F.col(f"_key_{position}"))
    joined = local.join(carries, match_keys, "left")
    return joined.select(
        *[F.col(name) for name in rows.columns if keep_chunks or name not in (_KEY, _CHUNK)],
        *[
            _combine(item, F.col(local_names[item.name]), F.col(carry_names[item.name]), F.col("_first")).alias(
                item.name
            )
            for item in items
        ],
    )
