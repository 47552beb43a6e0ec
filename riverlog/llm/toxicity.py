"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both are interpolated models over one vocabulary.  Words, and the stems of words
(lower case, no final marks, at most ``STEM`` bytes of whole characters), are hash
buckets.  Those whose counts of texts tell the classes apart beyond what chance
gives have an entry and are predicted by bigrams; a word without one is taken by
its stem if that has one.  A class's bigram counts back off to its continuation
counts (in how many contexts a word was seen), and these to the continuation counts
of both classes together, so a rare expression leans on what both have seen.
Every other word is predicted after its own bucket's counts, its contexts being the
texts it was seen in: those of the class, discounted, over those of both classes.
What it says counts as far as words with such counts are more than chance gives:
an expression that only a few toxic texts have speaks up if there are more of its
kind than there would be by dealing all words to the classes at random; a word that
neither class has seen says nothing.  No count is too low to matter.

A text's evidence is the difference of the two log-likelihoods per word.  A
logistic curve over it and over the root of the length makes it a score.  It is
fitted on a fold of the labelled texts to models that have not counted that fold;
then the models count it too.

Counts are gathered from all labelled texts: every task adds up arrays of fixed
size, which travel compressed in blocks and are summed in two steps.  The model
is BUCKETS words and at most VOCABULARY ** 2 cells, whatever the input, and so may
be sent to all tasks.  Words that share a bucket share its counts.

Results for odd input: a null, empty or blank text has evidence 0, whose score is
that of the curve there; labelled rows without a text, label or doc_id are not
learned from, and of several labels of one document the highest counts; with no
labelled rows, or of one class only, every score is the share of toxic rows (0 if
there are none); repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.llm.tables import written
from riverlog.llm.words import Words, mix, slices, words_of

BUCKETS = 1 << 21  # of words
STEMS = 1 << 18  # of stems, behind those of words
SIZE = BUCKETS + STEMS
VOCABULARY = 1 << 11  # the last entry is that of all other words
REST = VOCABULARY - 1
STEM = 6
# The least statistic of an entry: chance alone reaches it for one bucket in ten million.
LEAST_RATIO = 28.0
# Words of more texts than this, without an entry, are not told apart.
RARE = 64
MARKS = np.isin(np.arange(256), list(b".,;:!?"))
FOLDS = 5
CALIBRATION_FOLD = 4  # not counted by the model that the curve is fitted to
BLOCK = 1 << 14
SALTS = 64
LOW, HIGH, BINS = -2.0, 2.0, 4000  # of evidence, for the curve


def fold_of(column: str = "doc_id"):
    return (F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS).cast("int")


def _packed(array: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The blocks of an array of counts that are not all zero."""
    blocks = array.reshape(-1, BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    return used.tolist(), [zlib.compress(blocks[i].astype(np.int64).tobytes(), 1) for i in used]


def _counter(length: int, add):
    """Tasks that sum up ``add(counts, table part)`` and emit blocks of counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(length, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                add(counts, part)
        used, packed = _packed(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary())], names=["block", "counts"])

    return rows


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of a name, rows of which come one after another."""

    def out(name, total):
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"]
        )

    name = total = None
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            array = np.frombuffer(zlib.decompress(data), dtype=np.int64)
            if block == name:
                total = total + array
            else:
                if name is not None:
                    yield out(name, total)
                name, total = block, array
    if name is not None:
        yield out(name, total)


def summed(parts: DataFrame, length: int) -> np.ndarray:
    """The total of all tasks' counts, of a fixed length."""
    schema = "block bigint, counts binary"
    salted = parts.withColumn("salt", F.spark_partition_id() % SALTS)
    once = salted.repartition("block", "salt").sortWithinPartitions("block", "salt").select("block", "counts").mapInArrow(_adder, schema)
    twice = once.repartition("block").sortWithinPartitions("block").mapInArrow(_adder, schema)
    total = np.zeros(length, dtype=np.int64)
    for row in twice.toLocalIterator():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return total


def _bucket(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(43)).astype(np.int64)  # 21 bits


def _stem(words: Words) -> np.ndarray:
    end = words.end.copy()
    for _ in range(2):
        end -= MARKS[words.data[end - 1]] & (end - 1 > words.start) if len(end) else 0
    packed = np.zeros(len(end), dtype=np.uint64)
    stop = np.minimum(words.start + STEM, end)
    for _ in range(3):  # no character is cut
        if len(stop):
            inside = words.data[np.minimum(stop, len(words.data) - 1)] & 0xC0 == 0x80
            stop -= inside & (stop < end) & (stop > words.start)
    for i in range(STEM):
        at = np.minimum(words.start + i, max(len(words.data) - 1, 0))
        byte = np.where(words.start + i < stop, words.data[at] if len(at) else 0, 0).astype(np.uint64)
        packed |= byte << np.uint64(8 * i)
    return (mix(packed + np.uint64(1)) >> np.uint64(46)).astype(np.int64) + BUCKETS


def _entries(words: Words, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's entry and that of the word before it in its text (the entry of
    all other words before the first)."""
    here = entry[_bucket(words)].astype(np.int64)
    here = np.where(here == REST, entry[_stem(words)], here)
    before = np.empty_like(here)
    if len(here):
        before[1:] = here[:-1]
        before[words.first[:-1][np.diff(words.first) > 0]] = REST
    return here, before


def told_apart(by_class: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of each bucket's counts in the two classes."""
    total = by_class.sum(axis=1, keepdims=True).astype(float)
    pooled = by_class.sum(axis=0) / max(total.sum(), 1.0)
    expected = np.maximum(total * pooled, 1e-12)
    return 2 * (by_class * np.log(np.maximum(by_class, 1e-12) / expected)).sum(axis=0)


@dataclass
class Model:
    """Log-likelihood differences, toxic minus ordinary, and the curve."""

    entry: np.ndarray  # per bucket
    cells: np.ndarray  # seen bigrams, sorted: before * VOCABULARY + here
    seen: np.ndarray  # their differences
    context: np.ndarray  # of an unseen bigram: by the entry before
    word: np.ndarray  # and by its own
    other: np.ndarray  # of a word without an entry, by bucket
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the difference per word, and the number of words."""
        here, before = _entries(words, self.entry)
        cell = before * VOCABULARY + here
        at = np.minimum(np.searchsorted(self.cells, cell), max(len(self.cells) - 1, 0))
        value = self.context[before] + self.word[here]
        if len(self.cells):
            known = self.cells[at] == cell
            value = np.where(known, self.seen[at], value)
        value = np.where(here == REST, self.other[_bucket(words)], value)
        total = np.append(0.0, np.cumsum(value))
        size = np.diff(words.first)
        return (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(size, 1), size

    def scores(self, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + (b + c * _root(size)) * evidence, -30, 30)))


def _root(size: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(size, 4096)) / 16


def kneser_ney(counts: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From bigram counts (before, here): log p of every bigram, and the log of the
    back-off weight by the entry before and of the continuation by the entry here.
    ``shared`` are the continuation probabilities of both classes together."""

    def discount(values: np.ndarray) -> float:
        once, twice = int((values == 1).sum()), int((values == 2).sum())
        return once / (once + 2 * twice) if once and twice else 0.5

    types_here = (counts > 0).sum(axis=0).astype(float)
    d = discount(types_here)
    all_types = max(types_here.sum(), 1.0)
    backed = d * (types_here > 0).sum() / all_types if types_here.sum() else 1.0
    continuation = np.maximum(types_here - d, 0) / all_types + backed * shared
    d = discount(counts)
    before = counts.sum(axis=1).astype(float)
    weight = np.where(before > 0, d * (counts > 0).sum(axis=1) / np.maximum(before, 1), 1.0)
    p = np.maximum(counts - d, 0) / np.maximum(before, 1)[:, None] + weight[:, None] * continuation[None, :]
    return np.log(p), np.log(weight), np.log(continuation)


def believed(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per word the share of words with counts like its own, or more one-sided,
    that chance does not explain: 0 to 1.

    Under chance a word in n texts has a binomial number of toxic ones.  The words
    of each n are compared with that; two deviations are granted to chance."""
    n = ordinary + toxic
    share = toxic.sum() / max(n.sum(), 1)
    weight = np.zeros(len(n))
    weight[(n > RARE) & (told_apart(np.stack([ordinary, toxic])) >= LEAST_RATIO)] = 1.0
    for size in range(1, RARE + 1):
        mine = np.flatnonzero(n == size)
        if not len(mine) or not 0 < share < 1:
            continue
        k = np.arange(size + 1)
        chance = np.array([comb(size, i) for i in k], dtype=float) * share**k * (1 - share) ** (size - k)
        found = np.bincount(toxic[mine].astype(np.int64), minlength=size + 1)
        belief = np.zeros(size + 1)
        for counts, odds, side in (
            (np.cumsum(found[::-1])[::-1], np.cumsum(chance[::-1])[::-1], k > size * share),
            (np.cumsum(found), np.cumsum(chance), k < size * share),
        ):
            expected = len(mine) * odds
            excess = 1 - (expected + 2 * np.sqrt(expected)) / np.maximum(counts, 1)
            belief[side] = np.maximum(excess, 0)[side]
        weight[mine] = belief[toxic[mine].astype(np.int64)]
    return weight


def other_words(texts: np.ndarray) -> np.ndarray:
    """Log-likelihood differences of words by the texts of each class that have
    them (rows: ordinary, toxic), as far as they are believed.  A class's
    discounted counts are interpolated with those of both; what the discounts free
    is the same share of both models, so that a word neither has seen cancels."""
    both = texts.sum(axis=0).astype(np.float64)
    shared = both / max(both.sum(), 1.0)
    logs = []
    for counts in texts:
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        d = once / (once + 2 * twice) if once and twice else 0.5
        freed = d * max((counts > 0).sum(), 1) / max(counts.sum(), 1.0)
        own = np.maximum(counts - d, 0) / max(counts.sum(), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs.append(np.log1p(own / (freed * shared)))
    return np.where(both > 0, (logs[1] - logs[0]) * believed(*texts), 0.0).astype(np.float32)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fold) of the labelled rows that may be learned from."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("fold", fold_of()).where("fold <> 0")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").where(fold_of() != 0)
    # one plan at every size: labels grow with the documents, so no size of theirs is one to broadcast
    return texts.join(marks.hint("merge"), "doc_id").select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The curve of a model that has not counted one fold, on that fold, and the
    counts of all folds."""
    rows = written(_labelled(docs, labels), "labelled-texts")
    held_back = _calibrated(docs.sparkSession, counted(rows.where(f"fold <> {CALIBRATION_FOLD}")), rows.where(f"fold = {CALIBRATION_FOLD}"))
    model = counted(rows)
    model.curve = held_back.curve
    return model


def counted(learned: DataFrame) -> Model:
    """A model of (text, toxic) rows, without a curve."""
    spark = learned.sparkSession

    def add_words(counts, part):
        words = words_of(part.column("text"), lower=True)
        toxic = np.asarray(part.column("toxic")).astype(np.int64)[words.text]
        for bucket in (_bucket(words), _stem(words)):  # each once a text
            named = np.unique(words.text * 2 * SIZE + bucket + SIZE * toxic)
            np.add.at(counts, named % (2 * SIZE), 1)

    schema = "block bigint, counts binary"
    by_class = summed(learned.mapInArrow(_counter(2 * SIZE, add_words), schema), 2 * SIZE).reshape(2, SIZE)
    used = np.flatnonzero(by_class.any(axis=0))  # few at a time in the driver's memory
    ratio = told_apart(by_class[:, used])
    best = np.argsort(-ratio, kind="stable")[:REST]
    chosen = used[best[ratio[best] >= LEAST_RATIO]]
    words = used[used < BUCKETS]
    other = np.zeros(BUCKETS, dtype=np.float32)
    other[words] = other_words(by_class[:, words])
    del by_class, ratio
    entry = np.full(SIZE, REST, dtype=np.int16)
    entry[chosen] = np.arange(len(chosen))

    sent = spark.sparkContext.broadcast(entry)
    cells = VOCABULARY * VOCABULARY

    def add_pairs(counts, part):
        words = words_of(part.column("text"), lower=True)
        toxic = np.asarray(part.column("toxic")).astype(np.int64)
        here, before = _entries(words, sent.value)
        np.add.at(counts, before * VOCABULARY + here + cells * toxic[words.text], 1)

    pairs = summed(learned.mapInArrow(_counter(2 * cells, add_pairs), schema), 2 * cells).astype(np.int32)
    pairs = pairs.reshape(2, VOCABULARY, VOCABULARY)
    # only entries in use matter; those of no word would be predicted by nothing
    types = ((pairs[0] + pairs[1]) > 0).sum(axis=0).astype(float)
    shared = (types + 0.5) / (types + 0.5).sum()
    ordinary, toxic = kneser_ney(pairs[0], shared), kneser_ney(pairs[1], shared)
    seen = np.flatnonzero((pairs[0] + pairs[1]).ravel() > 0)
    return Model(
        entry,
        seen.astype(np.int64),
        (toxic[0] - ordinary[0]).ravel()[seen].astype(np.float32),
        (toxic[1] - ordinary[1]).astype(np.float32),
        (toxic[2] - ordinary[2]).astype(np.float32),
        other,
    )


def _calibrated(spark: SparkSession, model: Model, rows: DataFrame) -> Model:
    """Fits the curve to counts of texts by evidence, length and label, of a fixed size."""
    sent = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                evidence, size = sent.value.evidence(words_of(part.column("text"), lower=True))
                at = np.clip((evidence - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.log2(np.maximum(size, 1)).astype(np.int64)), part.column("toxic").cast(pa.int64())],
                    names=["at", "length", "toxic"],
                )

    bins = rows.mapInArrow(binned, "at bigint, length bigint, toxic bigint").groupBy("at", "length", "toxic").count().collect()
    if not bins:
        return model
    at, length, y, n = (np.array(c, dtype=float) for c in zip(*bins, strict=True))
    share = float((y * n).sum() / n.sum())
    if share in (0.0, 1.0):
        model.curve = (30.0 if share else -30.0, 0.0, 0.0)
        return model
    x = LOW + (at + 0.5) * (HIGH - LOW) / BINS
    features = np.stack([np.ones_like(x), x, x * _root(1.5 * 2**length)], axis=1)
    w = np.zeros(3)
    for _ in range(60):  # Newton steps on a ridge-penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (n * (y - p)) - 1e-2 * w
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w = w + step / max(1.0, float(np.abs(step).max()) / 20)
        if np.abs(step).max() < 1e-6:
            break
    model.curve = tuple(map(float, w))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, score double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = sent.value.scores(*sent.value.evidence(words_of(part.column("text"), lower=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, schema)
    held_out = F.coalesce(fold_of() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
