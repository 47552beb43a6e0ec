"""Hard negatives against brute force in whole numbers of any size."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from riverlog.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows):
    taken = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(q * q for q in whole) >= 2**59:
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        taken.setdefault(vec_id, []).append((label, hard_negatives._pack(np.array(whole, dtype=np.int64)), whole))
    taken = {vec_id: min(items)[::2] for vec_id, items in taken.items()}
    result = []
    for anchor, (label, a) in taken.items():
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), other, lb) for other, (lb, b) in taken.items() if other != anchor]
        scored.sort()
        for positive, vec_id, _ in [item for item in scored if item[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and -30 * positive <= -100 * s[0] <= -90 * positive][:10]
            result += [(anchor, vec_id, rank, s[1], -positive, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(result)


def mined(spark, rows, extra="", **options):
    vectors = spark.createDataFrame(rows, SCHEMA + extra)
    return sorted(tuple(row) for row in hard_negatives.mine(vectors, **options).collect())


def clustered(count, width, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    rows = []
    for vec_id in range(count):
        vector = centres[draw.integers(6)] + draw.normal(size=width) * draw.choice([0.05, 0.5])
        rows.append((vec_id, (vector * draw.choice([0.1, 1, 3])).tolist(), int(draw.integers(3))))
    return rows


@pytest.mark.parametrize("group_bytes", [1 << 26, 2000])
def test_equal_to_brute_force(spark, group_bytes):
    rows = clustered(900, 8)
    # a third of all rows is one vector; its ties go by vec_id
    rows += [(vec_id, [0.5] * 8, vec_id % 2) for vec_id in range(1000, 1450)]
    assert mined(spark, rows, group_bytes=group_bytes) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(250, 4)
    rows += [
        (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [math.nan, 0.0, 0.0, 0.0], 1),
        (303, [math.inf, 0.0, 0.0, 0.0], 1), (304, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1, 0.2, 0.3, 0.4], 1),
        (400, [0.0] * 4, 0), (401, [0.0] * 4, 1), (402, [], 2), (403, [1.0], 0), (404, [1.0] * 6, 1),
        (500, [-1.0, 0.5], 2), (600, [1e6, -2e5, 3.0, 4.0], 0), (601, [1e5, 0.0, 1.0, 2.0], 0),
        (602, [2e4, 5.0, 1.0, 2.0], 1), (700, [1e300] * 4, 1), (8, [0.3, 0.1, 0.2, 0.4], 0), (8, [0.3, 0.1, 0.2, 0.4], 0),
        (100, [9.0, 9.0, 9.0, 9.0], 2), (3, [0.1, 0.1, 0.1, 0.1], 1),
    ]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_no_anchors_and_extra_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [2.0], 2)]) == []
    rows = [(n, [1.0 + n, 2.0], n % 3) for n in range(30)]
    wide = [(*row, 1, "x") for row in rows]
    assert mined(spark, wide, ", group int, angles string") == brute(rows)


def test_stretches_hold_every_row_in_the_window_and_leave_out_others():
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(5, 6))
    lines = np.floor(np.repeat(centres, 200, axis=0) * 200 + draw.normal(size=(1000, 6)) * 10).astype(np.int64)
    norms = np.sqrt((lines.astype(float) ** 2).sum(axis=1))
    references = lines[:: 1000 // 8][:8]
    angle = hard_negatives._angles(references)
    packed = pa.RecordBatch.from_pydict(
        {
            "vec_id": np.arange(1000),
            "label": np.zeros(1000, np.int32),
            "parts": [hard_negatives._pack(line) for line in lines],
            "size": np.full(1000, 6, np.int32),
            "norm": norms,
        }
    )
    stored = next(iter(angle(iter([packed]))))
    group = hard_negatives._Group.of([stored])
    angles = np.asarray(stored.column("angles").flatten()).reshape(1000, -1)
    looked_at = 0
    for row in random.Random(1).sample(range(1000), 50):
        scores = group.lines.astype(np.int64) @ lines[row]
        low, high = sorted(random.Random(row).sample(scores.tolist(), 2))
        lo, hi = group.stretches(norms[[row]], angles[[row]], np.array([float(low)]), np.array([float(high)]))
        inside = np.zeros(1000, dtype=bool)
        for cell in range(lo.shape[1]):
            inside[lo[0, cell] : hi[0, cell]] = True
        assert not ((scores >= low) & (scores <= high) & ~inside).any()
        looked_at += inside.sum()
    assert looked_at < 50 * 1000 * 0.8
