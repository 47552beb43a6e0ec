"""Hard negatives by angular triangle filtering.

Components become whole numbers, and a row's score is its integer inner product
with an anchor.  Every row is stored with its norm and its angles to a few
reference directions.  By the triangle inequality on the sphere a row at angle b
and an anchor at angle a of one direction are between |a - b| and min(a + b,
2 pi - a - b) apart; the cosines times both norms, moved outwards by more than
any rounding, bound the score.  Wanted scores are a window, so in a cell (rows
whose nearest reference is the same) sorted by angle only one stretch of rows can
overlap it; a whole cell is left out by all references at once.  Only rows in
overlapping stretches are scored, in exact arithmetic.

Plan.  Rows are dealt to groups by a hash of vec_id, at most ``group_bytes`` of
numbers each and at least one group per shuffle partition.  Anchors, a stated
query set, are sent to the groups in waves of 1, 15, 240, ... groups: after each
wave a window starts at the worst of the best rows known so far, so that later
and larger waves return few rows.  The first search finds positives (any score,
the anchor's label), the second negatives (a window per positive, other labels).
In directions without clusters the bounds leave out little and nearly all rows
are scored; results are the same.

Odd input.  Rows with a null label, vector or component, or a component that is
not finite, take no part; neither do rows without a vec_id, nor rows whose whole
numbers have squares that sum to 2**59 or more, as scores might not fit.  Of rows
that share a vec_id the one with the smallest label, then vector, takes part.  A
shorter vector counts as filled up with zeros.  Ties go by vec_id.  An empty
table, or one without anchors, has no result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverlog.llm.tables import written

REFERENCES = 16
GROUP_BYTES = 64 << 20
WAVE = 16
SCALE = 256

# More than the rounding of stored angles, of cosines and of their inverses.
_SLACK = 1e-6
_MOST = 2**59
_ANCHORS_AT_ONCE, _ROWS_AT_ONCE = 128, 16384

_WHOLE = "vec_id bigint, label int, parts binary, size int, norm double"
_STORED = _WHOLE + ", angles array<double>"


# -- storing ----------------------------------------------------------------


def _whole_numbers(label_of):
    """Rows that take part, with their whole numbers as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            keep = pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("label")))
            batch = batch.filter(pc.and_(keep, pc.is_valid(vectors)))
            vectors = batch.column("embedding")
            sizes = np.asarray(pc.list_value_length(vectors)).astype(np.int64)
            values = np.asarray(pc.list_flatten(vectors).cast(pa.float64()).fill_null(math.nan))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * SCALE)
                squares = np.bincount(owner, scaled * scaled, len(sizes))
            fits = np.isfinite(squares) & (squares < _MOST)
            first = np.cumsum(sizes) - sizes
            whole = np.where(fits[owner], scaled, 0).astype(np.int64)
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            labels = label_of(ids, labels)
            rows = np.flatnonzero(fits)
            parts = [_pack(whole[first[row] : first[row] + sizes[row]]) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows]),
                    pa.array(labels[rows].astype(np.int32)),
                    pa.array(parts, pa.binary()),
                    pa.array(sizes[rows].astype(np.int32)),
                    pa.array(np.sqrt(squares[rows])),
                ],
                names=["vec_id", "label", "parts", "size", "norm"],
            )

    return run


def _pack(numbers: np.ndarray) -> bytes:
    """Two bytes each where they fit, else eight."""
    narrow = numbers.astype(np.int16)
    return (narrow if (narrow == numbers).all() else numbers).tobytes()


def _matrix(parts: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Packed rows as lines of one matrix, cut or filled up to ``width``."""
    out = np.zeros((len(parts), width), dtype=np.int64)
    for row, (data, size) in enumerate(zip(parts, sizes)):
        form = np.int16 if len(data) == 2 * size else np.int64
        line = np.frombuffer(data, dtype=form)[:width]
        out[row, : len(line)] = line
    return out


def _angles(references: np.ndarray):
    """Angles to the references; a row of zeros is at a right angle to all."""
    norms = np.sqrt((references.astype(np.float64) ** 2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            lines = _matrix(batch.column("parts").to_pylist(), sizes, references.shape[1]).astype(np.float64)
            length = np.maximum(batch.column("norm").to_numpy(), 1.0)[:, None]
            cosines = np.clip(lines @ references.T.astype(np.float64) / length / norms, -1, 1)
            angles = np.arccos(cosines)
            flat = pa.ListArray.from_arrays(
                np.arange(0, angles.size + 1, angles.shape[1], dtype=np.int32), pa.array(angles.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "angles"])

    return run


# -- one group --------------------------------------------------------------


@dataclass
class _Group:
    """Rows by cell and by angle to the cell's reference."""

    ids: np.ndarray
    labels: np.ndarray
    lines: np.ndarray
    norms: np.ndarray
    places: np.ndarray  # cell and angle as one rising number
    first: np.ndarray  # where each cell begins, and the end
    least: np.ndarray  # per cell: norms, and angles to every reference
    most: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> _Group:
        table = pa.Table.from_batches(batches)
        ids = table.column("vec_id").to_numpy()
        sizes = table.column("size").to_numpy()
        labels, norms = table.column("label").to_numpy(), table.column("norm").to_numpy()
        parts = table.column("parts").to_pylist()
        # of rows that share an id the first stays
        order = np.array(sorted(range(len(ids)), key=lambda row: (ids[row], labels[row], parts[row])))
        keep = order[np.unique(ids[order], return_index=True)[1]]
        angles = _flat(table.column("angles")).reshape(len(ids), -1)[keep]
        ids, labels, norms, sizes = ids[keep], labels[keep], norms[keep], sizes[keep]
        lines = _matrix([parts[row] for row in keep], sizes, max(int(sizes.max()), 1))
        cell = np.where(norms > 0, angles.argmin(axis=1), angles.shape[1])  # zeros have a cell of their own
        cells = angles.shape[1] + 1
        near = np.where(norms > 0, angles.min(axis=1), 0.0)
        places = cell * 10.0 + near
        order = np.argsort(places, kind="stable")
        first = np.searchsorted(cell[order], np.arange(cells + 1))
        norms, angles = norms[order], angles[order]
        least, most = np.ones(cells), np.ones(cells)
        low, high = np.zeros((cells, cells - 1)), np.zeros((cells, cells - 1))
        for c in range(cells):
            part = slice(first[c], first[c + 1])
            if first[c] < first[c + 1]:
                least[c], most[c] = norms[part].min(), norms[part].max()
                low[c], high[c] = angles[part].min(axis=0), angles[part].max(axis=0)
        exact = np.float64 if norms.max(initial=0) < 2**26 else np.int64
        return cls(
            ids[order], labels[order], lines[order].astype(exact), norms, places[order], first, least, most, low, high
        )

    def stretches(self, norm: np.ndarray, angles: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Per anchor and cell the rows whose score bounds overlap [low, high]."""
        cells = len(self.first) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            scale_low = np.where(low[:, None] >= 0, self.most, self.least) * norm[:, None]
            scale_high = np.where(high[:, None] >= 0, self.least, self.most) * norm[:, None]
            least_cosine = np.where(scale_low > 0, low[:, None] / scale_low, -2.0) - _SLACK
            most_cosine = np.where(scale_high > 0, high[:, None] / scale_high, 2.0) + _SLACK
        farthest = np.arccos(np.clip(least_cosine, -1, 1)) + _SLACK
        nearest = np.arccos(np.clip(most_cosine, -1, 1)) - _SLACK
        none = (least_cosine > 1) | (most_cosine < -1)
        # all references against the whole cell
        a = angles[:, None, :]
        apart = np.maximum(np.maximum(self.low - a, a - self.high), 0).max(axis=2)
        reach = np.minimum(a + self.high, 2 * math.pi - a - self.low).min(axis=2)
        none |= (apart > farthest + _SLACK) | (reach < nearest - _SLACK)
        # its own reference within the cell
        own = np.concatenate([angles, np.zeros((len(angles), 1))], axis=1)
        begin = np.maximum(own - farthest, nearest - own) - _SLACK
        end = np.minimum(own + farthest, 2 * math.pi - nearest - own) + _SLACK
        base = np.arange(cells) * 10.0
        lo = np.searchsorted(self.places, base + np.clip(begin, 0, 4))
        hi = np.searchsorted(self.places, base + np.clip(end, -1, 4), side="right")
        # zero rows and zero anchors score zero, whatever the angle
        free = np.zeros_like(none)
        free[:, -1] = True
        free[norm == 0] = True
        lo, hi = np.where(free, self.first[:-1], lo), np.where(free, self.first[1:], hi)
        hi = np.where(none & ~free, lo, hi)
        return lo, np.maximum(hi, lo)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten())


_FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


class _Best:
    """The best rows of each (anchor, slot) of some anchors, block after block."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.kept = [np.zeros(0, np.int64)] * 4  # anchor number, slot number, id, score

    def add(self, anchors, slots, ids, scores) -> None:
        both = [np.concatenate(pair) for pair in zip(self.kept, (anchors, slots, ids, scores))]
        order = np.lexsort((both[2], -both[3], both[1], both[0]))
        both = [column[order] for column in both]
        key = both[0] * 64 + both[1]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        self.kept = [column[rank < self.k] for column in both]

    def raise_floor(self, floor: np.ndarray) -> None:
        """Where k rows are known, only scores not below the worst count."""
        key = self.kept[0] * 64 + self.kept[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        for at in first[n == self.k]:
            worst = self.kept[3][at + self.k - 1]
            anchor, slot = self.kept[0][at], self.kept[1][at]
            floor[anchor, slot] = max(floor[anchor, slot], worst)


def _search_some(group: _Group, batch: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
    """The best k rows of the group in every window of some anchors."""
    count = batch.num_rows
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    norm = batch.column("norm").to_numpy()
    lines = _matrix(batch.column("parts").to_pylist(), batch.column("size").to_numpy(), group.lines.shape[1])
    exact = group.lines.dtype if norm.max(initial=0) < 2**26 else np.dtype(np.int64)
    lines = lines.astype(exact)
    angles = np.asarray(batch.column("angles").flatten()).reshape(count, -1)
    windows = batch.column("windows")
    slots = int(pc.max(pc.list_value_length(windows)).as_py())
    # windows that an anchor lacks are empty
    low = np.full((count, slots), np.iinfo(np.int64).max)
    high = np.full((count, slots), np.iinfo(np.int64).min)
    names = np.zeros((count, slots), dtype=np.int32)
    sizes = np.asarray(pc.list_value_length(windows))
    at = (np.repeat(np.arange(count), sizes), np.concatenate([np.arange(n) for n in sizes]))
    flat = windows.flatten()
    low[at], high[at], names[at] = (np.asarray(flat.field(n)) for n in ("low", "high", "slot"))
    best = _Best(k)
    lo, hi = group.stretches(norm, angles, low.min(axis=1).astype(float), high.max(axis=1).astype(float))
    for cell in range(lo.shape[1]):
        who = np.flatnonzero(lo[:, cell] < hi[:, cell])
        if not len(who):
            continue
        end = int(hi[who, cell].max())
        for begin in range(int(lo[who, cell].min()), end, _ROWS_AT_ONCE):
            part = slice(begin, min(end, begin + _ROWS_AT_ONCE))
            number = np.arange(part.start, part.stop)
            score = (lines[who] @ group.lines[part].astype(exact).T).astype(np.int64)
            right = (labels[who][:, None] == group.labels[part]) == same
            right &= ids[who][:, None] != group.ids[part]
            right &= (number >= lo[who, cell][:, None]) & (number < hi[who, cell][:, None])
            for slot in range(slots):
                fits = right & (score >= low[who, slot][:, None]) & (score <= high[who, slot][:, None])
                if fits.shape[1] > k:
                    # the k-th best of each line; its ties stay
                    held = np.where(fits, score, np.iinfo(np.int64).min)
                    fits &= score >= np.partition(held, -k, axis=1)[:, -k][:, None]
                line, place = np.nonzero(fits)
                if len(line):
                    best.add(who[line], np.full(len(line), slot), group.ids[part][place], score[line, place])
        best.raise_floor(low)
    anchor, slot, found, score = best.kept
    columns = [ids[anchor], names[anchor, slot], found, score]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])


def _search(k: int, same: bool):
    """Groups of rows, each followed by the anchors that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, group = None, [], None
        for batch in batches:
            groups, asks = batch.column("group").to_numpy(), np.asarray(batch.column("asks"))
            mark = groups * 2 + asks
            cuts = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1]))) if len(mark) else []
            for begin, end in zip(cuts, [*cuts[1:], len(mark)]):
                if groups[begin] != current:
                    current, rows, group = int(groups[begin]), [], None
                piece = batch.slice(begin, end - begin)
                if not asks[begin]:
                    rows.append(piece)
                    continue
                if group is None:
                    group, rows = (_Group.of(rows) if rows else False), []
                for first in range(0, piece.num_rows if group else 0, _ANCHORS_AT_ONCE):
                    yield _search_some(group, piece.slice(first, _ANCHORS_AT_ONCE), k, same)

    return run


# -- searches ---------------------------------------------------------------


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, anchors: DataFrame, windows: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows with a score in each window of each anchor.

    ``windows`` has ``anchor_id, slot, low, high``; rows have the anchor's label
    (``same``) or another one.  Result: ``anchor_id, slot, vec_id, score, rank``."""
    known, begin, size = None, 0, 1
    while begin < groups:
        end = min(groups, begin + size)
        asked = windows
        if known is not None:
            worst = known.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
            asked = asked.join(worst.where(F.col("n") == k), ["anchor_id", "slot"], "left")
            asked = asked.withColumn("low", F.greatest("low", "worst"))
        asked = asked.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("windows")
        )
        sent = anchors.join(asked, "vec_id")
        sent = sent.withColumn("group", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).withColumn("asks", F.lit(1))
        wave = rows.where(F.col("group").between(begin, end - 1)).withColumn("asks", F.lit(0))
        meet = wave.unionByName(sent, allowMissingColumns=True)
        meet = meet.repartition("group").sortWithinPartitions("group", "asks")
        found = meet.mapInArrow(_search(k, same), _FOUND)
        if known is not None:
            found = found.unionByName(known.select("anchor_id", "slot", "vec_id", "score"))
        known = written(_ranked(found, k), "op13-wave")
        begin, size = end, size * WAVE - size if size == 1 else size * WAVE
    return known


def _every_seventh(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.where(ids % 7 == 0, np.fmod(labels.astype(np.int64) + 1, 10), labels)


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    label_of=_every_seventh,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """For each anchor and each of its best ``positives``: the best ``negatives``
    whose score is within ``window`` percent of the positive's."""
    spark = vectors.sparkSession
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    taken = vectors.select("vec_id", "label", "embedding")
    whole = written(taken.mapInArrow(_whole_numbers(label_of), _WHOLE), "op13-whole")
    facts = whole.agg(F.count("*").alias("rows"), F.max("size").alias("width")).first()
    width = max(facts["width"] or 1, 1)
    chosen = whole.where("norm > 0").orderBy(F.xxhash64("vec_id"), "vec_id").select("parts", "size").limit(REFERENCES)
    chosen = chosen.collect()  # a fixed number of directions
    references = _matrix([bytes(row["parts"]) for row in chosen], np.array([row["size"] for row in chosen]), width)
    if not len(references):
        references = np.eye(1, width, dtype=np.int64)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, -(-facts["rows"] * width * 8 // group_bytes))
    stored = whole.mapInArrow(_angles(references), _STORED)
    # In 64-bit numbers: Python reads the column without a copy.
    stored = stored.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("bigint"))
    rows = written(stored, "op13-rows")
    first = Window.partitionBy("vec_id").orderBy("label", "parts")
    anchors = rows.where(anchor).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "group")
    least, most = -(2**62), 2**62
    everything = anchors.select(
        F.col("vec_id").alias("anchor_id"), F.lit(0).alias("slot"), F.lit(least).alias("low"), F.lit(most).alias("high")
    )
    found = search(rows, anchors, everything, groups, positives, same=True)
    found = found.select(
        "anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    share = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(share * window[0] / 100).cast("bigint"), F.floor(share * window[1] / 100).cast("bigint")
    bounded = found.select("anchor_id", "slot", low.alias("low"), high.alias("high")).where("low <= high")
    result = search(rows, anchors, bounded, groups, negatives, same=False)
    return result.join(found, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
