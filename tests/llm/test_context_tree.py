"""Context-tree weighting against a plain recursive version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riverlog.llm import context_tree


def words(text):
    lowered = (text or "").translate({code: code + 32 for code in range(65, 91)})
    return [word for word in re.split("[\x20\x09-\x0d]+", lowered) if word]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def decisions(data, place):
    for k in range(8):
        yield k, data[place] >> (8 - k), (data[place] >> (7 - k)) & 1


def plain_scores(rows):
    """doc_id -> tokens, known tokens, tokens learned from, base score, score."""
    depth = context_tree.DEPTH
    texts = [words(text) for _, text in rows]
    data = [b"\xfe" * depth + " ".join(text).encode() + b"\xff" for text in texts]
    counts = defaultdict(lambda: [0, 0])
    for (doc_id, _), line in zip(rows, data):
        if not held(doc_id):
            for place in range(depth, len(line)):
                for k, before, bit in decisions(line, place):
                    for d in range(depth + 1):
                        counts[line[place - d : place], k, before][bit] += 1
    children = defaultdict(list)
    for node in list(counts):
        if node[0]:
            children[node[0][1:], *node[1:]].append(node)

    def estimate(node):
        zeros, ones = counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    weighted = {}

    def weigh(node):
        if node not in weighted:
            own = estimate(node)
            if len(node[0]) == depth:
                weighted[node] = own, 1.0
            else:
                below = sum(weigh(child)[0] for child in children[node])
                total = math.log(0.5) + np.logaddexp(own, below)
                weighted[node] = total, math.exp(math.log(0.5) + own - total)
        return weighted[node]

    known = Counter()
    for (doc_id, _), text in zip(rows, texts):
        if not held(doc_id):
            known.update([*text, None])
    n, v = sum(known.values()), len(known)
    result = []
    for line, text in zip(data, texts):
        score = 0.0
        for place in range(depth, len(line)):
            for k, before, bit in decisions(line, place):
                chance, left, mixed = 0.5, 1.0, 0.0
                for d in range(depth + 1):
                    node = line[place - d : place], k, before
                    if node not in counts:
                        break
                    zeros, ones = counts[node]
                    guess, stop = (ones + 0.5) / (zeros + ones + 1), weigh(node)[1]
                    chance = mixed + left * guess
                    mixed += left * stop * guess
                    left *= 1 - stop
                score += math.log10(chance if bit else 1 - chance)
        tokens = [*text, None]
        base = sum(math.log10((known.get(token, 0) + 0.5) / (n + 0.5 * (v + 1))) for token in tokens)
        result.append((len(tokens), sum(known.get(token, 0) > 0 for token in tokens), n, base, score))
    return result


def sample_rows():
    draw = random.Random(4)
    parts = ["an", "the", "ou", "é", "re", "q", "zz"]
    rows = [
        (doc, " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(draw.randint(0, 30))))
        for doc in range(50)
    ]
    odd = [(100, None), (101, ""), (102, "  \n"), (None, "The THE an"), (103, "A b\tC\n"), (104, "xyzzy " * 2000)]
    return rows + odd + [(5, rows[5][1]), (5, rows[5][1]), (7, "tie"), (7, "tie")]


@pytest.mark.parametrize("block, shard", [(1 << 20, 1 << 20), (2000, 900)])
def test_scores_equal_the_plain_version_whatever_the_shards(spark, block, shard):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = context_tree.score(docs, block_bytes=block, shard_bytes=shard).collect()

    def ordered(items):
        return sorted(items, key=lambda item: (item[0] is None, item[0] or 0, item[-1]))

    ours = ordered(
        (row["doc_id"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"])
        for row in found
    )
    theirs = ordered((doc_id, *values) for (doc_id, _), values in zip(rows, plain_scores(rows)))
    assert [row[:4] for row in ours] == [row[:4] for row in theirs]
    for mine, other in zip(ours, theirs):
        assert mine[4:] == pytest.approx(other[4:], rel=1e-6, abs=1e-5)


def test_no_rows_and_extra_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 3.0, "x"), (6, None, 1.0, "y")], "doc_id bigint, text string, score double, block string"
    )
    rows = context_tree.score(docs).collect()
    assert {row["doc_id"]: row["n_bytes"] for row in rows} == {1: 4, 6: 1}
    assert context_tree.score(docs.limit(0)).collect() == []


def test_nothing_learned(spark):
    """All rows held out: every decision is even, and no token is known."""
    held_ids = [doc for doc in range(40) if held(doc)]
    docs = spark.createDataFrame([(doc, "ab") for doc in held_ids], "doc_id bigint, text string")
    for row in context_tree.score(docs).collect():
        assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0
        assert row["score"] == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-6)
        assert row["base_score"] == 0.0
