"""Expected grades by ordinal regression with cumulative links.

One weight vector over hashed text features and ordered thresholds: the chance
of a grade of at most k is the logistic of threshold k minus the text's value,
so all grades share the weights.  Features are words, and the last two bytes of
words with their case, hashed into ``DIMENSIONS`` numbers.

The model is fitted on a bounded sample: of the labelled rows the
``SAMPLE_ROWS`` of the smallest hash of their doc_id, all if there are fewer.
They are dealt into ``PARTS`` parts; in each of ``ROUNDS`` rounds every part
takes one pass from the common weights and the parts' results are averaged.
Order and parts follow hashes, so reruns agree.

Results for odd input: a null, empty or blank text has no features and the grade
of the thresholds alone; labelled rows without doc_id, grade or text are not
learned from; with no labelled rows all weights are 0 and every tail is 1;
repeated rows are graded each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import written
from riverlog.llm.words import Words, mix, slices, words_of

DIMENSIONS = 1 << 15
SAMPLE_ROWS = 20_000
PARTS = 8
ROUNDS = 5
RATE = 0.3
PENALTY = 1e-6


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, rising

    def tails(self, value: np.ndarray) -> np.ndarray:
        """Per value and threshold k: the chance of a grade above k."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds[None, :], -30, 30)))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text and feature in it: text, index and value; a text's values have length 1."""
    last = words.data[words.end - 1].astype(np.uint64) if len(words.end) else np.zeros(0, np.uint64)
    second = np.where(words.end - words.start > 1, words.data[words.end - 2] if len(words.end) else 0, 0).astype(np.uint64)
    head = words.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    upper = ((head >= 65) & (head <= 90)).astype(np.uint64)
    ending = mix(last | second << np.uint64(8) | upper << np.uint64(16) | np.uint64(1 << 20))
    text = np.concatenate([words.text, words.text])
    index = (np.concatenate([words.hash, ending]) >> np.uint64(49)).astype(np.int64)
    key, count = np.unique(text * DIMENSIONS + index, return_counts=True)
    text, index = key // DIMENSIONS, key % DIMENSIONS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(words.first) - 1))
    return text, index, value / np.maximum(norm[text], 1e-9)


def values(words: Words, weights: np.ndarray) -> np.ndarray:
    text, index, value = features(words)
    return np.bincount(text, value * weights[index], minlength=len(words.first) - 1)


def one_pass(model: Ordinal, words: Words, grades: np.ndarray, squares: np.ndarray) -> None:
    """Adaptive gradient steps, text by text, in place."""
    text, index, value = features(words)
    bounds = np.searchsorted(text, np.arange(len(grades) + 1))
    w, t = model.weights, model.thresholds
    for row, grade in enumerate(grades):
        i, x = index[bounds[row] : bounds[row + 1]], value[bounds[row] : bounds[row + 1]]
        eta = float(w[i] @ x)
        up = 1 / (1 + np.exp(-np.clip(t[grade] - eta, -30, 30))) if grade < len(t) else 1.0
        down = 1 / (1 + np.exp(-np.clip(t[grade - 1] - eta, -30, 30))) if grade > 0 else 0.0
        p = max(up - down, 1e-6)
        rise = (up + down - 1) * x - PENALTY * w[i]  # of the log-likelihood, by the weights
        squares[i] += rise * rise
        w[i] += RATE * rise / np.sqrt(squares[i])
        if grade < len(t):
            t[grade] += 0.02 * up * (1 - up) / p
        if grade > 0:
            t[grade - 1] -= 0.02 * down * (1 - down) / p
        np.maximum.accumulate(t, out=t)


def fit(docs: DataFrame, graded: DataFrame, grades: int, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """``graded``: (doc_id, grade), grades from 0 to ``grades`` - 1."""
    known = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the documented bound
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    place = F.xxhash64("doc_id", F.lit(3))
    rows = texts.join(F.broadcast(sample), "doc_id").select("text", "grade", place.alias("place"))
    rows = written(rows, "graded-texts")
    dealt = rows.repartition(PARTS, F.pmod("place", F.lit(PARTS))).sortWithinPartitions("place", "text")
    model = Ordinal(np.zeros(DIMENSIONS), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1))
    context = docs.sparkSession.sparkContext
    for _ in range(ROUNDS):
        sent = context.broadcast(model)

        def part(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Ordinal(sent.value.weights.copy(), sent.value.thresholds.copy())
            squares, n = np.full(DIMENSIONS, 1e-3), 0
            for batch in batches:
                for piece in slices(batch):
                    one_pass(own, words_of(piece.column("text")), np.asarray(piece.column("grade")), squares)
                    n += piece.num_rows
            state = np.concatenate([own.weights, own.thresholds]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state], pa.binary())], names=["n", "state"])

        parts = dealt.mapInArrow(part, "n bigint, state binary").collect()  # PARTS rows of fixed size
        total = sum(row["n"] for row in parts)
        if not total:
            return Ordinal(np.zeros(DIMENSIONS), np.full(grades - 1, -30.0))
        state = sum(np.frombuffer(row["state"]) * (row["n"] / total) for row in parts)
        model = Ordinal(state[:DIMENSIONS], state[DIMENSIONS:])
    return model


def grade(docs: DataFrame, model: Ordinal, at_least: int = 1) -> DataFrame:
    """Per row: doc_id, expected_grade, tail_prob (of a grade of ``at_least`` or
    more) and kept (tail_prob of a half or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tails = sent.value.tails(values(words_of(part.column("text")), sent.value.weights))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, at_least - 1]))],
                    names=["doc_id", "expected_grade", "tail_prob"],
                )

    graded = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, "doc_id bigint, expected_grade double, tail_prob double")
    return graded.withColumn("kept", F.col("tail_prob") >= 0.5)
