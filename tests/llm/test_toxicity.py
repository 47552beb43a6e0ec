"""Rare expressions count; chance does not."""

import math
import random

import numpy as np

from riverlog.llm import toxicity


def test_terms_of_few_toxic_texts_are_found(spark):
    draw = random.Random(5)
    vocabulary = [f"w{number}" for number in range(3000)]
    weights = [1 / (number + 1) for number in range(3000)]
    rows, labels = [], []
    for doc_id in range(3000):
        toxic = int(draw.random() < 0.12)
        words = draw.choices(vocabulary, weights, k=draw.randint(20, 80))
        if toxic:
            words.insert(draw.randint(0, len(words)), f"term{draw.randrange(60)}")
        rows.append((doc_id, " ".join(words)))
        labels.append((doc_id, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = [row for row in toxicity.toxicity(docs, marks).collect() if row["held_out"]]
    toxic = [row for row in held if labels[row["doc_id"]][2]]
    # a term has about five learned texts
    assert sum(row["predicted"] for row in toxic) >= 0.7 * len(toxic)
    assert sum(row["predicted"] for row in held if not labels[row["doc_id"]][2]) <= 0.01 * len(held)


def test_words_dealt_at_random_are_not_believed():
    draw = np.random.default_rng(3)
    size = draw.integers(1, 40, 20_000)
    toxic = draw.binomial(size, 0.12)
    assert (toxicity.believed(size - toxic, toxic) > 0.2).mean() < 0.002
    # forty words of four toxic texts each, among as many words of chance
    size, toxic = np.append(size, np.full(40, 4)), np.append(toxic, np.full(40, 4))
    assert (toxicity.believed(size - toxic, toxic)[-40:] > 0.7).all()


def test_other_words_are_kneser_ney_differences():
    texts = np.array([[5, 1, 0, 0, 2, 1, 7, 1], [0, 1, 4, 0, 1, 0, 2, 2]])
    both = texts.sum(axis=0) / texts.sum()
    expected = np.zeros(8)
    for sign, counts in zip((-1, 1), texts):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        d = once / (once + 2 * twice)
        freed = d * (counts > 0).sum() / counts.sum()
        for word in range(8):
            if both[word]:
                p = max(counts[word] - d, 0) / counts.sum() + freed * both[word]
                expected[word] += sign * math.log(p / (freed * both[word]))
    belief = toxicity.believed(*texts)
    assert np.allclose(toxicity.other_words(texts), expected * belief, atol=1e-6)
    assert toxicity.other_words(np.zeros((2, 4), dtype=np.int64)).tolist() == [0, 0, 0, 0]


def test_stems_cut_no_character(spark):
    import pyarrow as pa

    from riverlog.llm.words import words_of

    words = words_of(pa.array(["aééé aééè abcdefg abcdefh größe. größe"]))
    stems = toxicity._stem(words)
    assert stems[0] == stems[1] and stems[2] == stems[3] and stems[4] == stems[5] and len(set(stems.tolist())) == 3
