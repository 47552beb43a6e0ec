"""Repeated passages of ``window`` words, found by groups of window hashes.

No suffix is sorted and no suffix tree is built: 64-bit hashes of whole windows stand
for the suffixes cut at ``window`` words, and equal hashes in a group for the nodes at
that depth.  Of the windows with one hash all but the first are repeats; maximal
repeats are runs of neighbouring starts of such windows.

Sparse starts.  Every window holds an anchor: among its ``PREFIX``-word grams
the one of the smallest hash.  Equal windows have equal anchors, so windows are
grouped by their anchor gram, and neighbouring windows that share an anchor
travel as one row (a run).  Only anchors that occur twice anywhere travel at
all; the rest cannot be repeated.

Two lengths.  A group of more than ``GROUP_RUNS`` runs is split by the hash of
the whole window: its windows are spread by their own hash and reduced to the
first start with partial aggregation, so no task holds a hot passage.  All
other groups fit in ``GROUP_RUNS`` runs of at most ``RUN_WINDOWS`` windows.

Equal texts are reduced to the first of them beforehand.

Results for odd input: null and blank texts have no words; a row without a
``doc_id`` has no place in the order, so nothing is removed from it and it
makes nothing else a repeat; rows that share a ``doc_id`` are one place in the
order, so copies of a row are treated alike; extra columns are dropped
(``repeats``, ``remove_repeats``) or kept (``rewrite``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import written
from riverlog.llm.words import Words, gram_hashes, mix, slices, words_of

WINDOW = 20
PREFIX = 8
RUN_WINDOWS = 63  # starts a run carries at most, as many as a mask of one long holds
GROUP_RUNS = 4096
SALTS = 16
TAG_SHIFT = 40  # a position is the start, and above it bits of the text's hash

_U = np.uint64


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _smallest(grams: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` neighbours, by doubling."""
    n = len(grams) - span + 1
    width, best = 1, grams
    while width * 2 <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    return np.minimum(best[:n], best[span - width : span - width + n])


def anchored(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: key, text, start, length."""
    prefix = min(PREFIX, window)
    n = len(words.hash) - window + 1
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if n <= 0:
        return none
    anchor = _smallest(gram_hashes(words.hash, prefix), window - prefix + 1)
    at = np.flatnonzero(words.inside(window))
    if not len(at):
        return none
    anchor, text = anchor[at], words.text[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, len(at)))
    if length.max() > RUN_WINDOWS:
        parts = -(-length // RUN_WINDOWS)
        base = np.repeat(head, parts)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        tail = np.repeat(head + length, parts)
        head = base + nth * RUN_WINDOWS
        length = np.minimum(tail - head, RUN_WINDOWS)
    return anchor[head], text[head], at[head] - words.first[text[head]], length


def _recurring(words: Words, window: int) -> np.ndarray:
    """Texts in which a prefix gram comes again within one window or in the next place
    after it: neighbouring windows of one anchor, equal ones among them, are at most so far apart."""
    prefix = min(PREFIX, window)
    grams = gram_hashes(words.hash, prefix)
    found = np.zeros(len(words.first) - 1, dtype=bool)
    for step in range(1, window - prefix + 2):
        hit = np.flatnonzero(grams[step:] == grams[:-step]) if len(grams) > step else ()
        if len(hit):
            hit = hit[words.text[hit] == words.text[hit + step]]
            found[words.text[hit]] = True
    return found


def _anchor_rows(window: int):
    schema = pa.schema([("key", pa.int64()), ("th", pa.int64()), ("twice", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                key, text, _, _ = anchored(words, window)
                th = np.asarray(part.column("th"))
                frame = np.empty(len(key), dtype=[("k", np.int64), ("t", np.int64)])
                frame["k"], frame["t"] = _signed(key), th[text]
                # of a key that comes again in its text one row is enough, marked as such
                order = np.lexsort((frame["t"], frame["k"]))
                frame, again = frame[order], _recurring(words, window)[text][order]
                text = text[order]
                same = np.zeros(len(frame), dtype=bool)
                same[1:] = (frame[1:] == frame[:-1]) & (text[1:] == text[:-1])
                again |= same
                again[:-1] |= same[1:]
                keep = ~same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(frame["k"][keep]), pa.array(frame["t"][keep]), pa.array(again[keep])], schema=schema
                )

    return rows


def _shared_rows():
    """From rows sorted by (key, th): those of keys with two texts or a recurring
    one, each text once."""
    schema = pa.schema([("key", pa.int64()), ("th", pa.int64())])

    def out(key, th):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(th)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # (key, th, recurring, texts so far, whether the first was emitted)
        for batch in batches:
            key = np.asarray(batch.column("key"))
            th = np.asarray(batch.column("th"))
            twice = batch.column("twice").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            if state is not None:
                key, th = np.insert(key, 0, state[0]), np.insert(th, 0, state[1])
                twice = np.insert(twice, 0, state[2])
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (th[1:] != th[:-1])
            head = np.flatnonzero(fresh)
            again = np.logical_or.reduceat(twice, head)
            key, th = key[head], th[head]
            group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bounds = np.append(group, len(key))
            sizes = np.diff(bounds)
            carried = state[3] if state is not None else 0
            open_sizes = sizes.copy()
            open_sizes[0] += carried
            shared = (open_sizes >= 2) | np.logical_or.reduceat(again, group)
            mark = np.repeat(shared, sizes)
            # the last text stays open: more rows of it may follow
            emit = mark[:-1]
            yield out(key[:-1][emit], th[:-1][emit])
            last_shared = bool(shared[-1])
            state = (key[-1], th[-1], bool(again[-1]) or last_shared, int(open_sizes[-1]) - 1)
        if state is not None:
            if state[2] or state[3] >= 1:
                yield out(np.array([state[0]]), np.array([state[1]]))

    return rows


def _run_rows(window: int):
    """Runs whose anchor is among the text's shared ones, with their windows' hashes."""
    schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("hashes", pa.binary())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                key, text, start, length = anchored(words, window)
                lists = part.column("keys")
                sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
                wanted = np.asarray(lists.flatten()).view(np.uint64)
                keep = np.isin(key ^ mix(text.astype(np.uint64)), wanted ^ mix(owner))
                key, text, start, length = key[keep], text[keep], start[keep], length[keep]
                grams = gram_hashes(words.hash, window)
                begin = words.first[text] + start
                total = int(length.sum())
                flat = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)
                values = grams[flat].tobytes()
                offsets = np.append(0, np.cumsum(length * 8)).astype(np.int32)
                hashes = pa.Array.from_buffers(
                    pa.binary(), len(key), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)]
                )
                tag = np.asarray(part.column("tag"))
                doc = np.asarray(part.column("doc_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(key)), pa.array(doc[text]), pa.array(start | tag[text]), hashes], schema=schema
                )

    return rows


_MARKS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("mask", pa.int64())])


def subtree_repeats(key: np.ndarray, doc: np.ndarray, start: np.ndarray, runs: np.ndarray, hashes: np.ndarray):
    """Windows below a depth-``window`` node that are not its first, as flags.

    ``hashes`` are the windows of all runs in a row and ``runs`` the run each is
    of.  A node is first met at its smallest (doc, start).
    """
    node = hashes ^ mix(key[runs].view(np.uint64))
    nth = np.arange(len(runs)) - np.repeat(np.searchsorted(runs, np.arange(len(key))), np.bincount(runs, minlength=len(key)))
    order = np.lexsort((start[runs] + nth, doc[runs], node))
    later = np.zeros(len(node), dtype=bool)
    head = np.ones(len(node), dtype=bool)
    head[1:] = node[order][1:] != node[order][:-1]
    # rows that share a doc_id are one place: equal starts of it are all first
    place = np.flatnonzero(head)[np.cumsum(head) - 1]
    first = order[place]
    same = (doc[runs][order] == doc[runs][first]) & ((start[runs] + nth)[order] == (start[runs] + nth)[first])
    later[order] = ~same
    return later, nth


def _subtree_rows():
    """From runs sorted by key: marks of every group's repeats, group by group."""
    low = (1 << TAG_SHIFT) - 1

    def mark(table: pa.Table) -> pa.RecordBatch:
        key, doc, pos = (np.asarray(table.column(n)) for n in ("key", "doc_id", "pos"))
        column = table.column("hashes").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        size = np.asarray(pa.compute.binary_length(column), dtype=np.int64) // 8
        hashes = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64)
        runs = np.repeat(np.arange(len(key)), size)
        later, nth = subtree_repeats(key, doc, pos & low, runs, hashes)
        mask = np.zeros(len(key), dtype=np.uint64)
        np.bitwise_or.at(mask, runs[later], _U(1) << nth[later].astype(np.uint64))
        hit = mask != 0
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[hit]), pa.array(pos[hit]), pa.array(_signed(mask[hit]))], schema=_MARKS
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.asarray(batch.column("key"))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if held and held[0].column("key")[0].as_py() != key[-1] or last:
                done = pa.Table.from_batches([*held, batch.slice(0, last)])
                if done.num_rows:
                    yield mark(done)
                held = []
            held.append(batch.slice(last))
        if held:
            yield mark(pa.Table.from_batches(held))

    return rows


def _window_rows():
    """The windows of runs, one a row."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("tag", pa.int64())])
    low = (1 << TAG_SHIFT) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, pos = (np.asarray(batch.column(n)) for n in ("key", "doc_id", "pos"))
            size = np.asarray(pa.compute.binary_length(batch.column("hashes")), dtype=np.int64) // 8
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), dtype=np.uint64)
            runs = np.repeat(np.arange(len(key)), size)
            nth = np.arange(len(runs)) - np.repeat(np.cumsum(size) - size, size)
            node = _signed(mix(hashes ^ mix(key[runs].view(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(doc[runs]), pa.array((pos & low)[runs] + nth), pa.array((pos & ~low)[runs])],
                schema=schema,
            )

    return rows


def _texts(docs: DataFrame) -> DataFrame:
    tag = F.shiftleft(F.col("th").bitwiseAND(0x7FFFFF), TAG_SHIFT)
    return (
        docs.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("th", F.xxhash64("text"))
        .withColumn("tag", tag)
    )


def _marks(texts: DataFrame, window: int, group_runs: int) -> tuple[DataFrame, DataFrame]:
    """Masks of later windows by (doc_id, pos), and the texts that repeat an earlier one whole."""
    anchors = texts.select("text", "th").mapInArrow(_anchor_rows(window), "key bigint, th bigint, twice boolean")
    shared = written(
        anchors.repartition("key").sortWithinPartitions("key", "th").mapInArrow(_shared_rows(), "key bigint, th bigint"),
        "shared-prefixes",
    )
    names = written(texts.select("doc_id", "th", "tag", F.md5("text").alias("sum")).distinct(), "text-names")
    firsts = names.groupBy("sum").agg(F.min("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("tag").alias("tag"))
    keys = (
        shared.join(firsts, "th")
        .groupBy("doc_id", "th")
        .agg(F.collect_set("key").alias("keys"))
    )
    runs = (
        texts.join(keys.withColumnRenamed("th", "own"), "doc_id")
        .where("th = own")
        .select("doc_id", "text", "tag", "keys")
        .mapInArrow(_run_rows(window), "key bigint, doc_id bigint, pos bigint, hashes binary")
    )
    runs = written(runs, "suffix-runs")
    # runs, not texts: one text may hold any number of a key's
    sizes = runs.groupBy("key").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > group_runs).select("key"), "large-groups")
    marks = (
        runs.join(large, "key", "left_anti")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_subtree_rows(), "doc_id bigint, pos bigint, mask bigint")
    )
    windows = runs.join(large, "key", "left_semi").mapInArrow(
        _window_rows(), "node bigint, doc_id bigint, start bigint, tag bigint"
    )
    nodes = windows.groupBy("node").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    nodes = nodes.where("n > 1").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    later = (
        windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
        .join(nodes, ["node", "salt"])
        .where(F.struct("doc_id", "start") != F.col("first"))
        .select("doc_id", F.col("start").bitwiseOR(F.col("tag")).alias("pos"), F.lit(1).cast("bigint").alias("mask"))
    )
    copies = (
        names.join(firsts.select("sum", F.col("doc_id").alias("first_id")), "sum")
        .where("first_id < doc_id")
        .select("doc_id", "tag")
    )
    return marks.unionByName(later), copies


def _covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:-1] > 0


def later_starts(n_words: int, whole: bool, marks: list | None, tag: int, window: int) -> np.ndarray:
    """Starts of the windows of one text that repeat an earlier one."""
    if whole:
        return np.arange(max(0, n_words - window + 1))
    low = (1 << TAG_SHIFT) - 1
    starts = [
        (mark["pos"] & low) + bit
        for mark in marks or ()
        if mark["pos"] & ~low == tag
        for bit in range(RUN_WINDOWS)
        if mark["mask"] >> bit & 1
    ]
    return np.array(sorted(starts), dtype=np.int64)


def _marked(docs: DataFrame, window: int, group_runs: int) -> DataFrame:
    """All rows with ``whole`` and ``marks`` beside their columns."""
    texts = _texts(docs)
    marks, copies = _marks(texts, window, group_runs)
    by_doc = (
        marks.select("doc_id", F.struct("pos", "mask").alias("mark"), F.lit(None).cast("bigint").alias("copy"))
        .unionByName(copies.select("doc_id", F.lit(None).cast("struct<pos:bigint,mask:bigint>").alias("mark"), F.col("tag").alias("copy")))
        .groupBy("doc_id")
        .agg(F.collect_list("mark").alias("_marks"), F.collect_set("copy").alias("_copies"))
    )
    tag = F.shiftleft(F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFFFF), TAG_SHIFT)
    return (
        docs.withColumn("_doc", F.col("doc_id").cast("bigint"))
        .join(by_doc.withColumnRenamed("doc_id", "_doc"), "_doc", "left")
        .withColumn("_tag", tag)
        .withColumn("_whole", F.coalesce(F.array_contains("_copies", F.col("_tag")), F.lit(False)))
        .drop("_doc", "_copies")
    )


def _measured(window: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
         ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in schema]
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py() or ""
                words = text.encode().split()
                starts = later_starts(
                    len(words), batch.column("_whole")[row].as_py(), batch.column("_marks")[row].as_py(),
                    batch.column("_tag")[row].as_py(), window,
                )
                gone = _covered(starts, len(words), window)
                kept = words if not len(starts) else [w for w, out in zip(words, gone, strict=True) if not out]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                values = (
                    batch.column("doc_id")[row].as_py(), len(words), len(words) - len(kept),
                    hashlib.sha256(b" ".join(kept)).hexdigest(), spans,
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows


def repeats(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the maximal repeated spans
    (first and last word, in words) that a text of an earlier place also holds."""
    return _marked(docs.select("doc_id", "text"), window, group_runs).mapInArrow(
        _measured(window),
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:bigint,last:bigint>>",
    )


def rewrite(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS) -> DataFrame:
    """All rows and columns, the repeated passages cut from ``text``.  A text
    without repeats stays as it is; of others the white space around the cut
    words goes with them.  ``n_chars``, where there is one, follows the text."""
    columns = docs.columns

    @F.pandas_udf("string")
    def cut(text, whole, marks, tag):
        import pandas as pd

        out = []
        for t, w, m, g in zip(text, whole, marks, tag, strict=True):
            if t is None or (not w and (m is None or not len(m))):
                out.append(t)
                continue
            data = t.encode()
            words = data.split()
            starts = later_starts(len(words), w, list(m) if m is not None else None, g, window)
            if not len(starts):
                out.append(t)
                continue
            gone = _covered(starts, len(words), window)
            column = words_of(pa.array([t]))
            kept, at = [], 0
            for i in np.flatnonzero(gone):
                kept.append(data[at : column.start[i]])
                at = column.start[i + 1] if i + 1 < len(words) else len(data)
            kept.append(data[at:])
            out.append(b"".join(kept).decode())
        return pd.Series(out, dtype=object)

    changed = _marked(docs, window, group_runs).withColumn("text", cut("text", "_whole", "_marks", "_tag"))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*columns)
