"""Conversations as a prefix tree: what several share at their begin is there once.

A turn is formatted as ``<s>role\\ntext</s>``; control strings inside a role or
a text are broken by an escape that is undone when reading.  Turns of equal
role, text and history are one node.  A node belongs to the smallest
conversation through it, so the nodes a conversation owns are the tail of its
path: its branch.  Branches in the order of ``order`` are the tree depth-first,
a parent before its children and the deepest fork first; every node's text is
emitted in its owner's branch alone.

A node's position ids begin where its parent's end, so they count along the
path, not along the output.  What a conversation attends to are its intervals:
for each owner along the path the positions it gives, which are the ancestors
of the branch and nothing else.

Paths are made by windows and streamed digests in the order of turns; no
conversation is held whole.

Results for odd input: a null text is empty, a null role is an empty one; rows
without conv_id are one conversation of that name; turns of one number follow
one another by role and text; repeated rows are turns of their own; extra
columns are not read; an empty table gives only what ``extra`` rows give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverlog.llm.tables import written

# Strings with a meaning in a template, which texts must not bring in.
CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|<\|")
SCORED = "assistant"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return CONTROL.sub(lambda found: found[0][0] + "\\-" + found[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\n-])", lambda found: {"\\": "\\", "n": "\n", "-": ""}[found[1]], text)


def format_turn(role: str, text: str) -> str:
    return "<s>" + escape(role).replace("\n", "\\n") + "\n" + escape(text) + "</s>"


def read_turn(segment: str) -> tuple[str, str]:
    role, _, text = segment.removeprefix("<s>").removesuffix("</s>").partition("\n")
    return unescape(role), unescape(text)


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns in order: each with the digest of its path, depth and formatted text."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.string()), ("segment", pa.string()), ("chars", pa.int64())]
    )
    open_, name, path, depth = False, None, b"", 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if not open_ or conv != name:
                open_, name, path, depth = True, conv, b"", 0
            segment = format_turn(role, text)
            path = hashlib.blake2b(path + segment.encode(), digest_size=16).digest()
            rows.append({"conv_id": conv, "depth": depth, "node": path.hex(), "segment": segment, "chars": len(segment)})
            depth += 1
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def turns_of(conversations: DataFrame) -> DataFrame:
    empty = F.lit("")
    return conversations.select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )


class Tree:
    """``paths``: (conv_id, depth, node, owner, begin, end), the nodes along every
    conversation with their positions; ``nodes``: (node, segment) once each."""

    def __init__(self, conversations: DataFrame) -> None:
        turns = turns_of(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        rows = turns.mapInArrow(_node_rows, "conv_id bigint, depth bigint, node string, segment string, chars bigint")
        rows = written(rows, "chat-turns")
        self.nodes = written(rows.groupBy("node").agg(F.first("segment").alias("segment"), F.min("conv_id").alias("owner")), "chat-nodes")
        along = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
        begin = F.coalesce(F.sum("chars").over(along), F.lit(0))
        paths = rows.drop("segment").join(self.nodes.drop("segment"), "node")
        paths = paths.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("chars"))
        self.paths = written(paths, "chat-paths")

    def intervals(self) -> DataFrame:
        """Per conversation and owner along its path: the positions attended to,
        and the depth the owner's part begins at."""
        return self.paths.groupBy("conv_id", "owner").agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("depth").alias("depth")
        )

    def emitted(self) -> DataFrame:
        """The output: (branch, order, depth, begin, end, segment), one row per node;
        ``order`` sorts branches depth-first, ``begin`` is the first position id."""
        chain = F.array_sort(F.collect_list(F.struct("depth", F.col("owner").alias("branch"))))
        order = self.intervals().groupBy("conv_id").agg(chain.alias("chain"))
        order = order.select(
            F.col("conv_id").alias("owner"), F.transform("chain", lambda one: F.struct((-one["depth"]).alias("d"), one["branch"].alias("b"))).alias("order")
        )
        # the children of a tree's root part come after it; roots by their branch
        own = self.paths.where(F.col("conv_id").eqNullSafe(F.col("owner"))).drop("conv_id", "chars")
        rows = own.join(self.nodes.select("node", "segment"), "node")
        return rows.join(order, rows["owner"].eqNullSafe(order["owner"])).select(
            rows["owner"].alias("branch"), "order", "depth", "begin", "end", "segment"
        )

    def read_back(self) -> DataFrame:
        """Per conversation, from the emitted texts at the positions it attends to: conv_id,
        n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
        seen = self.intervals().select("conv_id", "owner", F.col("begin").alias("first"), F.col("end").alias("last"))
        output = self.emitted().select("branch", "begin", "end", "segment")
        within = (F.col("begin") >= F.col("first")) & (F.col("end") <= F.col("last"))
        rows = seen.join(output, F.col("owner").eqNullSafe(F.col("branch")) & within)
        rows = rows.select("conv_id", "begin", "segment").repartition("conv_id").sortWithinPartitions("conv_id", "begin")
        return rows.mapInArrow(
            _digest_rows,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        )


_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


class _Digest:
    def __init__(self, name: int | None) -> None:
        self.name, self.turns, self.loss, self.chars = name, 0, 0, 0
        self.all, self.scored = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        role, text = read_turn(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        if role == SCORED:
            self.loss += len(text)
            self.scored.update(text.encode())

    def row(self) -> dict:
        values = (self.name, self.turns, self.all.hexdigest(), self.loss, self.scored.hexdigest(), self.chars)
        return dict(zip(_DIGESTS.names, values, strict=True))


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current = None
    for batch in batches:
        rows = []
        for conv, segment in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist(), strict=True):
            if current is None or conv != current.name:
                if current is not None:
                    rows.append(current.row())
                current = _Digest(conv)
            current.add(segment)
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.row()], schema=_DIGESTS)
