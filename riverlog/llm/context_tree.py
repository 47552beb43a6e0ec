"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Model.  A text is its lower-cased words (A-Z only; a word is a run of bytes other
than white space) joined by one space, then an end mark.  Each byte is eight
binary decisions: decision k is told apart by the k bits before it and by the
``DEPTH`` bytes before the byte (a start mark stands before the text).  A node is
a context of 0 to DEPTH bytes with such a bit prefix, and counts the zeros and
ones seen there in the texts learned from.  Its Krichevsky-Trofimov estimate is
mixed with the product of its children's weighted probabilities, half and half,
at every depth.  A context never seen in the texts learned from predicts like
its longest seen suffix, so a text's probability is a proper product.

Plan.  Texts are dealt to blocks by a hash (about ``block_bytes`` each).
1. Each block emits its distinct (context, byte) grams and words, with counts of
   the texts learned from, packed by shard.  Grams are sorted by context, latest
   byte first, and cut into shards at quantiles of a sample of positions (the
   sample moves borders only, never results); words are sharded by hash.
2. A shard merges its grams and grows its part of the tree with numpy.  Contexts
   at both ends of a shard may go on in the next one: these alone (two paths of
   DEPTH + 1 contexts a shard, at most 255 nodes each) are returned and joined.
3. With the joined paths every shard prices its grams and answers each block.
4. Texts meet the prices of their block, sorted first in the block, and are
   summed in a stream.
Two shuffles of the texts; all else is packed distinct grams.  Nothing depends on
a hot gram: a block has each once.

Odd input.  A null text is empty: it is the end mark alone.  A null doc_id is
learned from (its fold is no number).  Repeated rows are scored one by one and
count each time.  An empty table gives an empty result.  Other columns of the
input are not looked at and not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import written
from riverlog.llm.words import Words, mix, slices, words_of

DEPTH = 6
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 32 << 20
# One position in so many is read for the borders of the shards.
BORDER_STRIDE = 4096

_U = np.uint64
# Bytes that no UTF-8 text holds.
_START, _END = 0xFE, 0xFF
_END_WORD = mix(np.array([0x5EED], dtype=np.uint64))[0]
_GRAMS, _WORDS, _TEXTS = 0, 1, 2
_LOG_HALF = math.log(0.5)

_PACKED = "kind int, shard int, block bigint, size bigint, keys binary, counts binary"


# -- packing ----------------------------------------------------------------


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _restore(data: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, size).T).view(kind).reshape(size)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=_U(0)))


def _unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_restore(data, size, np.uint64), dtype=np.uint64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class _Tally:
    """Distinct keys and counts of a stream of arrays, merged when they double."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0
        self.settled = 1 << 20

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * self.settled:
            k, c = self.result()
            self.keys, self.counts, self.held = [k], [c], len(k)
            self.settled = max(self.settled, len(k))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.keys, self.counts)


# -- grams of texts ---------------------------------------------------------


def _grams(words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the normal form, and where each text begins.

    A gram is the DEPTH bytes before, latest in the highest place, and the byte."""
    per_text = words.first[1:] - words.first[:-1]
    empty = np.flatnonzero(per_text == 0)
    # a text without words is one unit of no bytes
    at = words.first[empty]
    start = np.insert(words.start, at, 0)
    length = np.insert(words.end - words.start, at, 0)
    owner = np.insert(words.text, at, empty)
    stop = np.cumsum(length + 1)
    begin = stop - length - 1
    total = int(stop[-1]) if len(stop) else 0
    source = np.repeat(start - begin, length + 1) + np.arange(total)
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    body = words.data[np.minimum(source, len(words.data) - 1)] if len(words.data) else np.zeros(total, np.uint8)
    body[stop - 1] = np.where(last, _END, 0x20)
    first = begin[np.concatenate(([True], last[:-1]))] if len(owner) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, total))
    inside = np.arange(total) - np.repeat(first, sizes)
    gram = body.astype(np.uint64)
    for back in range(1, DEPTH + 1):
        before = np.full(total, _START, dtype=np.uint64)
        before[back:] = body[: max(0, total - back)]
        before[inside < back] = _START
        gram |= before << _U(8 * (DEPTH + 1 - back))
    assert len(first) == texts
    return gram, first


def _word_keys(words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end mark after each text, and where each text begins."""
    return np.insert(words.hash, words.first[1:], _END_WORD), words.first[:-1] + np.arange(texts)


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part in slices(batch):
        yield part, words_of(part.column("text"), lower=True)


def _border_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words in _steps(batch):
            grams, _ = _grams(words, part.num_rows)
            taken = np.unique(grams[(len(grams) % BORDER_STRIDE) // 2 :: BORDER_STRIDE])
            yield pa.RecordBatch.from_pydict({"gram": pa.array(taken.astype(np.int64))})


def _block_keys(borders: np.ndarray, word_shards: int):
    """Per block: packed distinct grams and words by shard."""
    word_step = (1 << 64) // word_shards + 1

    def rows(block: int, kind: int, tally: _Tally) -> Iterator[dict]:
        keys, counts = tally.result()
        if kind == _GRAMS:
            shard = np.searchsorted(borders, keys, side="right")
        else:
            shard = (keys // _U(word_step)).astype(np.int64) if word_shards > 1 else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(keys) else []
        for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
            part = slice(begin, end)
            yield {
                "kind": kind,
                "shard": int(shard[begin]),
                "block": block,
                "size": int(end - begin),
                "keys": _pack_keys(keys[part]),
                "counts": _squeeze(counts[part]),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tallies = None, {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for begin, end in _stretches(blocks):
                if blocks[begin] != current:
                    yield from _batches_of(_PACKED_TYPE, (r for k, t in tallies.items() for r in rows(current, k, t)))
                    current, tallies = int(blocks[begin]), {_GRAMS: _Tally(), _WORDS: _Tally()}
                for part, words in _steps(batch.slice(begin, end - begin)):
                    learn = ~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
                    for kind, (keys, first) in (
                        (_GRAMS, _grams(words, part.num_rows)),
                        (_WORDS, _word_keys(words, part.num_rows)),
                    ):
                        weight = np.repeat(learn, np.diff(np.append(first, len(keys))))
                        known, n = np.unique(keys[weight], return_counts=True)
                        tallies[kind].add(known, n.astype(np.int64))
                        if not learn.all():
                            asked = np.unique(keys[~weight])
                            tallies[kind].add(asked, np.zeros(len(asked), np.int64))
        yield from _batches_of(_PACKED_TYPE, (r for k, t in tallies.items() for r in rows(current, k, t)))

    return run


_PACKED_TYPE = pa.schema(
    [
        ("kind", pa.int32()),
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("size", pa.int64()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
    ]
)


def _batches_of(schema: pa.Schema, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """A batch per row: rows hold whole arrays."""
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)])


# -- the tree ---------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up, for x > 0."""
    product = np.ones_like(x)
    for step in range(8):
        product = product * (x + step)
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of such counts."""
    value = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)
    return np.where(zeros + ones > 0, value, 0.0)


@dataclass
class _Level:
    """Distinct keys (context of d bytes, byte) of one depth, and for each the
    place of its shorter-context key one level above."""

    keys: np.ndarray
    counts: np.ndarray
    above: np.ndarray | None = None


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[_Level]:
    levels = [_Level(grams, counts.astype(np.float64))]
    for _ in range(DEPTH):
        below = levels[-1]
        shorter = ((below.keys >> _U(16)) << _U(8)) | (below.keys & _U(255))
        keys, below.above = np.unique(shorter, return_inverse=True)
        levels.append(_Level(keys, np.bincount(below.above, below.counts, len(keys))))
    return levels[::-1]


@dataclass
class _Nodes:
    """Nodes of one depth and one decision: runs of keys that share a prefix."""

    run: np.ndarray  # the node of each key
    prefix: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    open: np.ndarray  # may go on in another shard
    parent: np.ndarray | None
    estimate: np.ndarray
    below: np.ndarray  # summed weighted logarithms of closed children
    weighted: np.ndarray


def _grow(levels: list[_Level], k: int) -> list[_Nodes]:
    """All nodes of decision k, weighted from the deepest up.  What open nodes
    lack of other shards is not in their sums."""
    nodes: list[_Nodes] = []
    for depth, level in enumerate(levels):
        prefix = level.keys >> _U(8 - k)
        first = np.concatenate(([True], prefix[1:] != prefix[:-1]))
        run, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        bit = ((level.keys >> _U(7 - k)) & _U(1)).astype(np.float64)
        zeros = np.bincount(run, level.counts * (1 - bit), len(starts))
        ones = np.bincount(run, level.counts * bit, len(starts))
        context = level.keys[starts] >> _U(8)
        opened = (context == context[0]) | (context == context[-1])
        parent = nodes[-1].run[level.above[starts]] if depth else None
        none = np.zeros(len(starts))
        nodes.append(
            _Nodes(run, prefix[starts], zeros, ones, opened, parent, _log_estimate(zeros, ones), none, none)
        )
    for depth in range(DEPTH, -1, -1):
        at = nodes[depth]
        if depth == DEPTH:
            at.weighted = at.estimate
        else:
            child = nodes[depth + 1]
            at.below = np.bincount(child.parent, np.where(child.open, 0.0, child.weighted), len(at.prefix))
            at.weighted = _LOG_HALF + np.logaddexp(at.estimate, at.below)
    return nodes


_PATH_TYPE = np.dtype(
    [("depth", "i8"), ("k", "i8"), ("prefix", "u8"), ("zeros", "f8"), ("ones", "f8"), ("below", "f8")]
)


def _paths(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The open nodes of a shard."""
    levels = _levels(grams, counts)
    parts = []
    for k in range(8):
        for depth, at in enumerate(_grow(levels, k)):
            rows = np.zeros(int(at.open.sum()), dtype=_PATH_TYPE)
            rows["depth"], rows["k"] = depth, k
            for name in ("prefix", "zeros", "ones", "below"):
                rows[name] = getattr(at, name)[at.open]
            parts.append(rows)
    return np.concatenate(parts)


@dataclass
class _Joined:
    """Joined nodes of one depth and decision, ready for use from above."""

    prefix: np.ndarray
    mass: np.ndarray  # left for deeper contexts
    share: np.ndarray  # probability of a one, as far as mixed down to here
    one: np.ndarray  # probability of a one where the context ends here


def _step_down(zeros, ones, stop, mass, share, one):
    """Mix one depth more: what remains, what is mixed, and the prediction."""
    guess = (ones + 0.5) / (zeros + ones + 1)
    predicted = np.where(zeros + ones > 0, share + mass * guess, one)
    return mass * (1 - stop), share + mass * stop * guess, predicted


def join_paths(rows: np.ndarray) -> dict[tuple[int, int], _Joined]:
    """One tree of all shards' open nodes, weighted up and mixed down."""
    result: dict[tuple[int, int], _Joined] = {}
    for k in range(8):
        tables = []
        for depth in range(DEPTH + 1):
            mine = rows[(rows["depth"] == depth) & (rows["k"] == k)]
            prefix, back = np.unique(mine["prefix"], return_inverse=True)
            sums = [np.bincount(back, mine[name], len(prefix)) for name in ("zeros", "ones", "below")]
            tables.append([prefix, *sums])
        stops, ups = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
        for depth in range(DEPTH, -1, -1):
            prefix, zeros, ones, below = tables[depth]
            estimate = _log_estimate(zeros, ones)
            if depth == DEPTH:
                weighted, stops[depth] = estimate, np.ones(len(prefix))
            else:
                weighted = _LOG_HALF + np.logaddexp(estimate, below)
                stops[depth] = np.exp(_LOG_HALF + estimate - weighted)
            if depth:
                shorter = ((prefix >> _U(k + 8)) << _U(k)) | (prefix & _U((1 << k) - 1))
                ups[depth] = np.searchsorted(tables[depth - 1][0], shorter)
                tables[depth - 1][3] += np.bincount(ups[depth], weighted, len(tables[depth - 1][0]))
        for depth in range(DEPTH + 1):
            prefix, zeros, ones, _ = tables[depth]
            if depth == 0:
                mass, share, one = np.ones(len(prefix)), np.zeros(len(prefix)), np.full(len(prefix), 0.5)
            else:
                above = result[depth - 1, k]
                mass, share, one = above.mass[ups[depth]], above.share[ups[depth]], above.one[ups[depth]]
            result[depth, k] = _Joined(prefix, *_step_down(zeros, ones, stops[depth], mass, share, one))
    return result


def _prices(grams: np.ndarray, counts: np.ndarray, joined: dict[tuple[int, int], _Joined]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    levels = _levels(grams, counts)
    price = np.zeros(len(grams))
    for k in range(8):
        mass = share = one = None
        for depth, at in enumerate(_grow(levels, k)):
            if depth:
                mass, share, one = mass[at.parent], share[at.parent], one[at.parent]
                stop = np.exp(_LOG_HALF + at.estimate - at.weighted) if depth < DEPTH else np.ones(len(at.prefix))
                mass, share, one = _step_down(at.zeros, at.ones, stop, mass, share, one)
            else:  # the root is open in every shard
                mass, share, one = (np.zeros(len(at.prefix)) for _ in range(3))
            known = joined[depth, k]
            places = np.searchsorted(known.prefix, at.prefix[at.open])
            mass[at.open], share[at.open], one[at.open] = known.mass[places], known.share[places], known.one[places]
        of_one = one[at.run]
        price += np.log10(np.where((grams >> _U(7 - k)) & _U(1) == 1, of_one, 1 - of_one))
    return price


_GROWN = "kind int, shard int, size bigint, keys binary, counts binary, paths binary, total bigint, known bigint"
_GROWN_TYPE = pa.schema(
    [
        ("kind", pa.int32()),
        ("shard", pa.int32()),
        ("size", pa.int64()),
        ("keys", pa.binary()),
        ("counts", pa.binary()),
        ("paths", pa.binary()),
        ("total", pa.int64()),
        ("known", pa.int64()),
    ]
)


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a (kind, shard) to one row with its keys, and its open nodes."""
    at, tally = None, _Tally()

    def row() -> dict:
        keys, counts = tally.result()
        return {
            "kind": at[0],
            "shard": at[1],
            "size": len(keys),
            "keys": _pack_keys(keys),
            "counts": _squeeze(counts),
            "paths": _paths(keys, counts).tobytes() if at[0] == _GRAMS else None,
            "total": int(counts.sum()),
            "known": int((counts > 0).sum()),
        }

    for batch in batches:
        for item in _rows(batch):
            if (item["kind"], item["shard"]) != at:
                if at is not None:
                    yield from _batches_of(_GROWN_TYPE, iter([row()]))
                at, tally = (item["kind"], item["shard"]), _Tally()
            tally.add(_unpack_keys(item["keys"], item["size"]), _restore(item["counts"], item["size"], np.int64))
    if at is not None:
        yield from _batches_of(_GROWN_TYPE, iter([row()]))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for number in range(batch.num_rows):
        yield {name: batch.column(name)[number].as_py() for name in batch.schema.names}


def _answers(joined: dict[tuple[int, int], _Joined]):
    """Shard by shard: first its own row, then the blocks', which get prices of
    their grams and counts of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, values = None, None, None
        for batch in batches:
            for item in _rows(batch):
                mine = _unpack_keys(item["keys"], item["size"])
                if item["block"] is None:
                    at, keys = (item["kind"], item["shard"]), mine
                    counts = _restore(item["counts"], item["size"], np.int64)
                    values = _prices(keys, counts, joined) if item["kind"] == _GRAMS else counts
                    continue
                assert at == (item["kind"], item["shard"])
                found = values[np.searchsorted(keys, mine)]
                found = found.astype(np.float32) if item["kind"] == _GRAMS else found
                item["counts"] = _squeeze(np.ascontiguousarray(found))
                yield from _batches_of(_PACKED_TYPE, iter([item]))

    return run


# -- scores -----------------------------------------------------------------

_SCORES = (
    "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double, n_bytes bigint"
)


def _score_texts(total: int, known: int):
    """Blocks of texts, each behind its prices.  ``total`` and ``known`` count
    the tokens learned from and the different ones among them."""

    def looked_up(table: tuple[np.ndarray, np.ndarray], asked: np.ndarray) -> np.ndarray:
        order = np.argsort(asked)
        out = np.empty(len(asked), dtype=np.float64)
        out[order] = table[1][np.searchsorted(table[0], asked[order])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, tables = None, None, None
        for batch in batches:
            kinds, blocks = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            for begin, end in _stretches(blocks * 4 + kinds):
                if blocks[begin] != current:
                    current, tables = int(blocks[begin]), None
                    parts = {_GRAMS: ([], []), _WORDS: ([], [])}
                piece = batch.slice(begin, end - begin)
                kind = int(kinds[begin])
                if kind != _TEXTS:
                    for item in _rows(piece.select(["size", "keys", "counts"])):
                        parts[kind][0].append(_unpack_keys(item["keys"], item["size"]))
                        form = np.float32 if kind == _GRAMS else np.int64
                        parts[kind][1].append(_restore(item["counts"], item["size"], form))
                    continue
                if tables is None:
                    tables = {k: (np.concatenate(a), np.concatenate(b)) for k, (a, b) in parts.items()}
                    parts = None
                for part, words in _steps(piece):
                    grams, first = _grams(words, part.num_rows)
                    score = np.add.reduceat(looked_up(tables[_GRAMS], grams), first)
                    keys, begins = _word_keys(words, part.num_rows)
                    counts = looked_up(tables[_WORDS], keys)
                    base = np.log10((counts + 0.5) / (total + 0.5 * (known + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("held_out"),
                            pa.array(np.diff(np.append(begins, len(keys)))),
                            pa.array(np.add.reduceat((counts > 0).astype(np.int64), begins)),
                            pa.array(np.full(part.num_rows, total, dtype=np.int64)),
                            pa.array(np.add.reduceat(base, begins)),
                            pa.array(score),
                            pa.array(np.diff(np.append(first, len(grams)))),
                        ],
                        names=["doc_id", *[name.split()[0] for name in _SCORES.split(", ")]],
                    )

    return run


def held_out(id_column: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Rows that a model must not learn from: one fold of the checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))


def score(
    docs: DataFrame,
    hold: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per document: ``score``, the log10 probability of the text, and beside it
    the unigram score of its words (``base_score``), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``n_bytes`` of the normal form with its end mark, and
    ``bits_per_byte``, the code length.  Rows where ``hold`` is true are scored
    but not learned from."""
    spark = docs.sparkSession
    hold = held_out() if hold is None else hold
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), hold.alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, shards = (max(1, -(-size // part)) for part in (block_bytes, shard_bytes))
    borders = np.zeros(0, np.uint64)
    if shards > 1:
        sample = rows.select("text").mapInArrow(_border_sample, "gram bigint").distinct()
        cuts = [F.lit(n / shards) for n in range(1, shards)]
        found = sample.agg(F.percentile_approx("gram", F.array(*cuts), F.lit(100_000)).alias("cuts")).first()["cuts"]
        borders = np.unique(np.array(found or [], dtype=np.uint64))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint"))
    by_block = placed.repartition("block").sortWithinPartitions("block")
    packed = written(by_block.mapInArrow(_block_keys(borders, shards), _PACKED), "op11-keys")
    grown = packed.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    grown = written(grown.mapInArrow(_merge_shards, _GROWN), "op11-shards")
    # Two paths a shard: bounded by the number of shards, not by what they hold.
    paths = [row["paths"] for row in grown.where(f"kind = {_GRAMS}").select("paths").toLocalIterator()]
    joined = join_paths(np.concatenate([np.frombuffer(p, dtype=_PATH_TYPE) for p in paths] or [np.zeros(0, _PATH_TYPE)]))
    token = grown.where(f"kind = {_WORDS}").agg(F.sum("total").alias("n"), F.sum("known").alias("v")).first()
    own = grown.select("kind", "shard", F.lit(None).cast("bigint").alias("block"), "size", "keys", "counts")
    asked = own.unionByName(packed).repartition("kind", "shard")
    asked = asked.sortWithinPartitions("kind", "shard", F.col("block").asc_nulls_first())
    prices = asked.mapInArrow(_answers(joined), _PACKED)
    texts = placed.withColumns({"kind": F.lit(_TEXTS), "shard": F.lit(0)})
    meet = prices.unionByName(texts, allowMissingColumns=True)
    meet = meet.repartition("block").sortWithinPartitions("block", "kind", "shard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    body = _score_texts(token["n"] or 0, token["v"] or 0)
    scored = meet.mapInArrow(body, f"doc_id {kind}, {_SCORES}")
    bits = -F.col("score") / math.log10(2) / F.col("n_bytes")
    return scored.withColumn("bits_per_byte", bits)
