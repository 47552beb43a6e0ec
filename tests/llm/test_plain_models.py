"""Fingerprints against plain SimHash; grades on rows that were held out."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from riverlog.llm import fingerprints, quality_grade

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def plain_bits(text):
    words = [word for word in re.split("[\x20\x09-\x0d]+", text) if word]
    votes = np.zeros(64, dtype=np.int64)

    def vote(value, weight):
        for bit in range(64):
            votes[bit] += weight if value >> bit & 1 else -weight

    for word, after in zip(words, [*words[1:], None]):
        value = xxhash.xxh64_intdigest(word.encode(), 42)
        vote(value, 1)
        if after is not None:
            vote(xxhash.xxh64_intdigest(after.encode(), value), fingerprints.PAIR_VOTES)
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def plain_fingerprints(rows):
    """Of rows with distinct ids: the contract, row by row."""
    rows = sorted(((doc_id, text or "") for doc_id, text in rows), reverse=True)
    bits = [plain_bits(text) for _, text in rows]
    result = {}
    for at, (doc_id, text) in enumerate(rows):
        after = (at + 1) % len(rows)
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[after][1][:half]
        own, other = bits[at], plain_bits(edited)
        result[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016X}", f"{other:016X}",
            1 - (own ^ other).bit_count() / 64, 1 - (own ^ bits[after]).bit_count() / 64,
        )
    return result


def test_fingerprints_equal_plain_simhash(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(-5, None), (10**6, ""), (10**6 + 700, "one"), (10**6 + 701, "woréd " * 9000), (10**7, " \t two words ")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    found = {row["doc_id"]: tuple(row[name] for name in columns) for row in fingerprints.fingerprints(docs).collect()}
    assert found == plain_fingerprints([(row["doc_id"], row["text"]) for row in docs.collect()])


def test_near_counts_equal_all_pairs(spark):
    from riverlog.llm.catalog import op2_fingerprints

    rows = op2_fingerprints(spark, SMALL).collect()
    bits = {row["doc_id"]: int(row["fingerprint"], 16) for row in rows}
    for row in rows:
        if row["doc_id"] % 20:
            assert row["n_near"] is None
        else:
            near = sum((bits[row["doc_id"]] ^ other).bit_count() <= fingerprints.RADIUS for other in bits.values())
            assert row["n_near"] == near


def test_grades_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").where("quality IS NOT NULL")
    graded = {row["doc_id"]: row["quality"] for row in labels.collect()}
    held = {doc_id for doc_id in graded if zlib.crc32(str(doc_id).encode()) % 5 == 0}
    learned = [(doc_id, quality) for doc_id, quality in graded.items() if doc_id not in held]
    model = quality_grade.fit(docs, spark.createDataFrame(learned, "doc_id bigint, grade int"), grades=2)
    rows = [row for row in quality_grade.grade(docs, model).collect() if row["doc_id"] in held]
    good = [row["expected_grade"] for row in rows if graded[row["doc_id"]] == 1]
    poor = [row["expected_grade"] for row in rows if graded[row["doc_id"]] == 0]
    right = np.mean([a > b for a in good for b in poor])
    assert len(good) > 20 and len(poor) > 5 and right > 0.85


def test_steps_follow_the_gradient():
    import pyarrow as pa

    from riverlog.llm.words import words_of

    words, grade, penalty = words_of(pa.array(["some words for some grade"])), 1, quality_grade.PENALTY
    model = quality_grade.Ordinal(np.zeros(quality_grade.DIMENSIONS), np.array([-0.7, 0.4]))
    text, index, value = quality_grade.features(words)
    model.weights[index] = 0.1
    thresholds = model.thresholds.copy()

    def likelihood(weights):
        eta = (weights[index] * value).sum()
        up, down = (1 / (1 + np.exp(-(t - eta))) for t in (thresholds[1], thresholds[0]))
        return np.log(up - down) - penalty / 2 * (weights[index] ** 2).sum()

    before = model.weights.copy()
    squares = np.zeros(quality_grade.DIMENSIONS)
    quality_grade.one_pass(model, words, np.array([grade]), squares)
    for at in index:
        step = np.zeros_like(before)
        step[at] = 1e-6
        slope = (likelihood(before + step) - likelihood(before - step)) / 2e-6
        assert np.sqrt(squares[at]) == pytest.approx(abs(slope), rel=1e-4, abs=1e-9)
        assert np.sign(model.weights[at] - before[at]) == np.sign(slope)


def test_grades_of_odd_rows(spark):
    rows = [(1, "good words here", 5, "x"), (2, None, 5, "x"), (3, "", 5, "x"), (None, "bad", 5, "x"), (1, "good words here", 5, "x"),
            (4, "bad bad bad", 5, "x"), (5, "long " * 200_000, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int, kept string")
    marks = [(1, 1), (1, 0), (4, 0), (2, 1), (None, 1), (5, None), (99, 1)]
    model = quality_grade.fit(docs, spark.createDataFrame(marks, "doc_id bigint, grade int"), grades=2)
    found = quality_grade.grade(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= row["tail_prob"] <= 1 for row in found)
    empty = {round(row["tail_prob"], 9) for row in found if row["doc_id"] in (2, 3)}
    assert len(empty) == 1
    same = {row["tail_prob"] for row in found if row["doc_id"] == 1}
    assert len(same) == 1
    assert quality_grade.grade(docs.limit(0), model).collect() == []
