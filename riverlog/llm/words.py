"""Words of whole texts as arrays of hashes, for the operators that run in tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return.  Bytes are hashed in bounded blocks; what is kept per
text is one number per word, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# What one step works on: texts are taken together up to so many bytes.
STEP_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_bytes = np.random.default_rng(20240229)
_TABLE = _bytes.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input reaches every bit of the result."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _pow(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, 1 << 16) * 5 // 4
        inverse = pow(base, -1, 1 << 64)
        both = []
        for factor in (base, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        known = _powers[base] = (both[0], both[1])
    return known


@dataclass
class Words:
    """Words of some texts in a row.  ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text begins in data, and the end
    start: np.ndarray  # byte positions of each word
    end: np.ndarray
    text: np.ndarray  # the text each word is of
    first: np.ndarray
    hash: np.ndarray

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash of every ``size`` consecutive words, and which lie in one text."""
        return gram_hashes(self.hash, size), self.inside(size)

    def inside(self, size: int) -> np.ndarray:
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        return self.text[:n] == self.text[size - 1 :]


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _pow(_WORD_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[:n])


def span_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each of the stretches ``first[i]:first[i+1]``, whatever its length."""
    power, inverse = _pow(_WORD_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    lengths = (first[1:] - first[:-1]).astype(np.uint64)
    return mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]] + mix(lengths + _U(77)))


def _cuts(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Blocks of one or more texts, cut only where no word is cut."""
    while begin < end:
        stop = min(end, begin + 4 * STEP_BYTES)
        while stop < end:
            gaps = np.flatnonzero(SPACE[data[max(begin, stop - 65536) : stop]])
            if len(gaps):
                stop = max(begin, stop - 65536) + int(gaps[-1]) + 1
                break
            stop = min(end, stop + 65536)
        yield begin, stop
        begin = stop


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words of the texts of one array; a null text has none."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        upper = (data >= 65) & (data <= 90)
        data = data + (upper * np.uint8(32))
    starts, ends, hashes = [], [], []
    for begin, stop in _cuts(data, 0, len(data)):
        block = data[begin:stop]
        edge = offsets[(offsets > begin) & (offsets < stop)] - begin
        space = SPACE[block]
        opens = ~space
        opens[1:] &= space[:-1]
        closes = ~space
        closes[:-1] &= space[1:]
        if len(edge):
            opens[edge] = ~space[edge]
            closes[edge - 1] = ~space[edge - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        power, inverse = _pow(_BASE, len(block) + 1)
        total = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[block] * power[: len(block)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        starts.append(s + begin)
        ends.append(e + begin)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    text = np.searchsorted(offsets, start, side="right") - 1
    # texts of no bytes share an offset; the last of them is the one with bytes
    first = np.searchsorted(text, np.arange(len(column) + 1))
    return Words(data, offsets, start, end, text, first, value)


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about STEP_BYTES of text, at least a row each."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    begin, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > STEP_BYTES:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
