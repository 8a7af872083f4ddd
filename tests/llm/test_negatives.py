import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivemill.llm import op11_hard_negatives as op

SCHEMA = "vec_id bigint, embedding array<float>, label int, number string, row int, score double"


def brute(rows, step, positives=5, negatives=5, low=80, high=100):
    """The rows asked for, by sorting all scores of each anchor."""
    usable = {
        (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, label, v in usable:
        if i % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for j, other, w in usable if j != i)
        same = dict.fromkeys((s, j) for s, j, other in scored if other == label)
        different = dict.fromkeys((s, j) for s, j, other in scored if other != label)
        for p, j in list(same)[:positives]:
            inside = [(s, k) for s, k in different if low * -p <= 100 * -s <= high * -p]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, step, **kw):
    frame = spark.createDataFrame([(*r, "n", 1, 0.5) for r in rows], SCHEMA)
    return sorted(map(tuple, op.hard_negatives(frame, F.col("vec_id") % step == 0, **kw).collect()))


@pytest.mark.parametrize("shape", [(3, 5, 4), (65, 64, 131), (100, 37, 90), (1, 70, 70), (130, 129, 2)])
def test_strassen_equals_the_plain_product(shape):
    pick = np.random.default_rng(sum(shape))
    m, k, n = shape
    for top in (300, 1 << 28):
        a, b = pick.integers(-top, top, (m, k)), pick.integers(-top, top, (k, n))
        exact = (a.astype(object) @ b.astype(object)).astype(np.int64)
        assert (op.strassen(a, b, leaf=8) == exact).all() and (op.strassen(a, b) == exact).all()


def test_heaps_merge_in_any_order():
    pick = random.Random(3)
    entries = [(pick.randrange(4), pick.randrange(6), pick.randrange(40)) for _ in range(300)]
    heaps = op.Heaps(5, 5)
    for start in range(0, 300, 37):
        heaps.push(*map(np.array, zip(*entries[start : start + 37], strict=True)))
    wanted = [(g, s, i) for g in range(4) for s, i in sorted({(s, i) for h, s, i in entries if h == g}, key=lambda e: (-e[0], e[1]))[:5]]
    assert list(zip(*map(np.ndarray.tolist, heaps.entries()), strict=True)) == wanted


def test_window_is_exact():
    p = np.array([0, 1, 7, 101, -3, (1 << 61) + 1])
    least, most = op.window(p, 80, 100)
    for v, a, b in zip(p.tolist(), least.tolist(), most.tolist(), strict=True):
        assert 80 * v <= 100 * a and 80 * v > 100 * (a - 1) and 100 * b <= 100 * v < 100 * (b + 1)


def rows_of(n, seed, width=40):
    pick = np.random.default_rng(seed)
    centre = pick.normal(size=width)
    return [(i, [float(x) for x in centre + 0.7 * pick.normal(size=width)], int(pick.integers(4))) for i in range(n)]


@pytest.mark.parametrize("chunk_bytes", [op.CHUNK_BYTES, 9000])
def test_negatives_are_those_of_all_scores(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(op, "TILE", 64)
    rows = rows_of(400, 1)
    hot = rows[9][1]  # a third of all rows hold one vector
    rows += [(1000 + i, hot, i % 3) for i in range(200)] + rows[:30]
    wanted = brute(rows, 10)
    assert len(wanted) > 500 and found(spark, rows, 10, chunk_bytes=chunk_bytes) == wanted


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *rows_of(60, 2, 6),
        (None, [1.0] * 6, 1), (61, None, 1), (62, [1.0, None], 1), (63, [nan, 1.0], 1), (64, [inf, 1.0], 1), (65, [1.0] * 6, None),
        (66, [], 1), (67, [2.0, 3.0], 2), (70, [1.0] * 9, 3), (70, [0.5] * 9, 3), (80, [], 2),
    ]
    assert found(spark, rows, 5) == brute(rows, 5)
    big = [*rows[:60], (90, [3e38] * 6, 1)]
    assert found(spark, big, 5) == brute(big[:-1], 5)
    assert found(spark, rows, 5, positives=2, negatives=3, low=50, high=120) == brute(rows, 5, 2, 3, 50, 120)
    assert found(spark, [], 5) == [] and found(spark, rows, 1000)[:1] == brute(rows, 1000)[:1]


def test_labels_of_any_type(spark):
    rows = rows_of(80, 4, 8)
    frame = spark.createDataFrame([(i, v, f"label {x}") for i, v, x in rows], "vec_id bigint, embedding array<double>, label string")
    out = sorted(map(tuple, op.hard_negatives(frame, F.col("vec_id") % 8 == 0).collect()))
    assert [r[:4] for r in out] == [r[:4] for r in brute([(i, [float(np.float64(x)) for x in v], y) for i, v, y in rows], 8)]
