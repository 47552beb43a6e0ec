"""Prefix trie of conversations, totals of subtrees by time-forward processing.

A node is a distinct sequence of first turns; conversations that start with it
are its members.

1. A conversation becomes one narrow row: 16 bytes of digest and the length of
   every turn.  Texts are read once and not shuffled.
2. Rows are range-sorted by their digests and conv_id, so that a node's members
   lie next to each other.  Each range is a shard.  Ranges are balanced whatever
   the tree looks like: a common first turn or thousands of equal conversations
   are cut across shards.  A shard streams its rows once, compares neighbours and
   writes its nodes; only nodes on the path of its first or its last row can have
   members elsewhere, and are marked open.
3. Nodes of a shard are sorted externally by reverse level order and streamed:
   every node takes the messages addressed to it from a priority queue, which
   spills, and sends its subtree's totals to its parent.  Open nodes keep what
   they have received.
4. The open nodes of ``FAN`` neighbouring shards (two paths each) are merged and
   passed on in the same way, until one shard is left.

Members that end at a node come in ascending order of conv_id; their digest is
taken in the stream.  Where they are many or go on in another shard, pieces of
the id list are written and digested in order, in a stream.

What one task must hold: one conversation's row (about 24 bytes a turn) and the
current path.  Odd input: rows without a conv_id belong to no conversation and
are left out; a null role or text is empty; a null turn comes first; turns that
tie are ordered by their digest; repeated rows are turns of their own; very long
texts are hashed where they are read; an empty table has no nodes, not even a
root.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import written

MARK_BYTES = 16
# Shards whose open nodes meet in one task.
FAN = 1024
# Messages a queue holds in memory; ids in one piece of a list of ends.
QUEUE_ITEMS = 1 << 16
PIECE_IDS = 4096

_ROOT = bytes(MARK_BYTES)
_BATCH_ROWS = 4096
_NODE = (
    "shard int, depth int, node binary, parent binary, conv_id bigint, n_convs bigint, size bigint, "
    "open_left boolean, open_right boolean, ends string, in_pieces boolean, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint"
)
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_BUILT = _NODE + ", piece int, ids string"


def _arrow(names: list[str], ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    types = dict(part.split() for part in ddl.split(", "))
    return pa.schema([(name, kinds[types[name]]) for name in names])


class _Out:
    """Rows gathered into batches."""

    def __init__(self, ddl: str) -> None:
        self.names = [part.split()[0] for part in ddl.split(", ")]
        self.schema = _arrow(self.names, ddl)
        self.rows: list[tuple] = []

    def full(self) -> bool:
        return len(self.rows) >= _BATCH_ROWS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.names]
        arrays = [pa.array(list(column), field.type) for column, field in zip(columns, self.schema)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


# -- conversations ----------------------------------------------------------


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: mark and size of every turn, in order."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    parts = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    mark = F.unhex(F.substring(F.sha2(parts, 256), 1, 2 * MARK_BYTES))
    narrow = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", mark.alias("mark"), F.char_length(text).alias("size")).alias("turn")
    )
    gathered = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["mark"], t["size"])))


def with_shared_heads(convs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Give every conversation c the first h turns of conversation c - c % group
    in place of its own, h being the checksum of c modulo ``most`` + 1.

    At most ``group`` conversations share a head."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("lead")
    )
    joined = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left")
    lead = F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(0)))
    return joined.select("conv_id", F.concat(lead, own).alias("turns"))


# -- nodes of a shard -------------------------------------------------------


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("node", "since", "conv_id", "size", "left", "ids", "pieces")

    def __init__(self, node: bytes, since: int, size: int, left: bool) -> None:
        self.node, self.since, self.size, self.left = node, since, size, left
        self.conv_id: int | None = None
        self.ids: list[int] = []
        self.pieces = 0


def _common(a: bytes, b: bytes) -> int:
    """How many whole marks two rows share in front."""
    limit = min(len(a), len(b))
    if a[:limit] == b[:limit]:
        return limit // MARK_BYTES
    low, high = 0, limit // MARK_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * MARK_BYTES] == b[: middle * MARK_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations of one shard to its nodes."""
    shard = TaskContext.get().partitionId()
    out, path = _Out(_BUILT), []
    blank = (None,) * len(_NAMES)
    before, seen = b"", 0

    def piece(depth: int, at: _Open) -> None:
        values = dict(zip(_NAMES, blank)) | {"shard": shard, "depth": depth, "node": at.node}
        out.rows.append((*values.values(), at.pieces, ",".join(map(str, at.ids))))
        at.ids, at.pieces = [], at.pieces + 1

    def close(right: bool) -> None:
        at, depth = path.pop(), len(path)
        if at.ids and (at.left or right or at.pieces):
            piece(depth, at)
        ends = hashlib.sha256(",".join(map(str, at.ids)).encode()).hexdigest()
        parent = path[-1] if path else None
        if parent is not None and (parent.conv_id is None or at.conv_id < parent.conv_id):
            parent.conv_id = at.conv_id
        out.rows.append(
            (
                shard, depth, at.node, parent.node if parent else None, at.conv_id, seen - at.since, at.size,
                at.left, right, ends, at.pieces > 0, 0, 0, 0, None, None,
            )
        )

    for batch in batches:
        for conv_id, key, sizes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "sizes"))):
            shared = _common(before, key) if seen else -1
            while len(path) - 1 > shared:
                close(False)
            if not path:
                path.append(_Open(_ROOT, 0, 0, True))
            for depth in range(len(path) - 1, len(sizes)):
                mark = key[depth * MARK_BYTES : (depth + 1) * MARK_BYTES]
                node = hashlib.sha256(path[-1].node + mark).digest()[:MARK_BYTES]
                path.append(_Open(node, seen, sizes[depth], seen == 0))
            end = path[-1]
            end.conv_id = conv_id if end.conv_id is None else min(end.conv_id, conv_id)
            end.ids.append(conv_id)
            if len(end.ids) == PIECE_IDS:
                piece(len(path) - 1, end)
            before, seen = key, seen + 1
            if out.full():
                yield out.take()
    while path:
        close(True)
        if out.full():
            yield out.take()
    yield out.take()


# -- time-forward processing ------------------------------------------------


class SpillingQueue:
    """A priority queue of tuples that holds ``most`` of them in memory.

    More are written as a sorted run to the folder that Spark gives a task for
    its spills; the files have no name and vanish with the task."""

    def __init__(self, most: int = QUEUE_ITEMS) -> None:
        self.most = most
        self.items: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.items, item)
        if len(self.items) > self.most:
            self._spill()

    def _spill(self) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        run: IO[bytes] = tempfile.TemporaryFile(dir=folder)
        self.items.sort()
        for begin in range(0, len(self.items), 1024):
            pickle.dump(self.items[begin : begin + 1024], run)
        run.seek(0)
        self.items = []
        self.runs.append(_read_run(run))
        self._advance(len(self.runs) - 1)

    def _advance(self, number: int) -> None:
        item = next(self.runs[number], None)
        if item is not None:
            heapq.heappush(self.heads, (item, number))

    def pop_all(self, address: tuple) -> Iterator[tuple]:
        """Take the items that start with ``address``; none before it is left."""
        width = len(address)
        while self.items and self.items[0][:width] <= address:
            yield heapq.heappop(self.items)
        while self.heads and self.heads[0][0][:width] <= address:
            item, number = heapq.heappop(self.heads)
            self._advance(number)
            yield item


def _read_run(run: IO[bytes]) -> Iterator[tuple]:
    with run:
        while True:
            try:
                items = pickle.load(run)
            except EOFError:
                return
            yield from items


def _forward(most: int):
    """Nodes by shard and reverse level order; totals go to parents in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, queue = _Out(_NODE), None, SpillingQueue(most)
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in _NAMES)):
                item = dict(zip(_NAMES, row))
                if item["shard"] != shard:
                    shard, queue = item["shard"], SpillingQueue(most)
                for _, _, children, leaves, saved in queue.pop_all((-item["depth"], item["node"])):
                    item["n_children"] += children
                    item["n_leaves"] += leaves
                    item["saved_tokens"] += saved
                if not (item["open_left"] or item["open_right"]):
                    item["n_leaves"] = item["n_leaves"] or 1
                    item["saved_tokens"] += (item["n_convs"] - 1) * item["size"]
                    if item["depth"]:
                        totals = (1, item["n_leaves"], item["saved_tokens"])
                        queue.push((1 - item["depth"], item["parent"], *totals))
                out.rows.append(tuple(item.values()))
                if out.full():
                    yield out.take()
        yield out.take()

    return run


def _pass_up(nodes: DataFrame, most: int, name: str) -> DataFrame:
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
    return written(ordered.mapInArrow(_forward(most), _NODE), name)


def _merged(opened: DataFrame, fan: int) -> DataFrame:
    """Open nodes of neighbouring shards as nodes of one shard; closed if all
    shards there are have met."""
    wide = opened.withColumn("wide", F.floor(F.col("shard") / fan).cast("int"))
    edges = wide.groupBy("wide").agg(F.min("shard").alias("least"), F.max("shard").alias("greatest"))
    span = wide.agg(F.min("wide").alias("least"), F.max("wide").alias("greatest")).first()
    on = F.lit(span["least"] != span["greatest"])
    wide = wide.join(edges, "wide")
    return wide.groupBy(F.col("wide").alias("shard"), "node").agg(
        F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.max("size").alias("size"),
        F.bool_or(on & F.col("open_left") & (F.col("shard") == F.col("least"))).alias("open_left"),
        F.bool_or(on & F.col("open_right") & (F.col("shard") == F.col("greatest"))).alias("open_right"),
        F.max("ends").alias("ends"),
        F.bool_or("in_pieces").alias("in_pieces"),
        *[F.sum(total).alias(total) for total in ("n_children", "n_leaves", "saved_tokens")],
    ).select(*_NAMES)


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, current, digest = _Out("node binary, ends string"), None, None
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != current:
                if current is not None:
                    out.rows.append((current, digest.hexdigest()))
                current, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out.full():
            yield out.take()
    if current is not None:
        out.rows.append((current, digest.hexdigest()))
    yield out.take()


def trie(convs: DataFrame, fan: int = FAN, queue_items: int = QUEUE_ITEMS) -> DataFrame:
    """All nodes of the trie of ``convs`` (``conv_id``, ``turns``), with totals."""
    marks = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), ""))
    rows = convs.select("conv_id", marks.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    sharded = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    built = written(sharded.mapInArrow(_build, _BUILT), "op12-nodes")
    passed = _pass_up(built.where("piece IS NULL").select(*_NAMES), queue_items, "op12-shards")
    is_open = F.col("open_left") | F.col("open_right")
    closed, opened = passed.where(~is_open), passed.where(is_open)
    late, current = passed.limit(0), opened
    while not current.isEmpty():
        current = _pass_up(_merged(current, fan), queue_items, "op12-roots")
        late = late.unionByName(current.where(~is_open))
        current = current.where(is_open)
    # A shard holds a copy of every parent of its nodes; the parent's smallest
    # member is looked up there, so that a parent of many children is no hot key.
    places = opened.groupBy("node").agg(F.min("shard").alias("shard"))
    late = late.drop("shard").join(places, "node").select(*_NAMES)
    whole = closed.unionByName(late)
    members = closed.select("shard", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = opened.select("shard", "node").join(late.select("node", "conv_id"), "node")
    members = members.unionByName(
        shared.select("shard", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    )
    whole = whole.join(members, ["shard", "parent"], "left")
    pieces = built.where("piece IS NOT NULL").select("node", "shard", "piece", "ids")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece")
    digests = pieces.mapInArrow(_digest_pieces, "node binary, ends string").withColumnRenamed("ends", "joined_ends")
    in_pieces = whole.where("in_pieces").join(digests, "node").withColumn("ends", F.col("joined_ends"))
    result = whole.where("NOT in_pieces").unionByName(in_pieces.drop("joined_ends"))
    return result.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )
