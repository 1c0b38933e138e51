import math
import random

import numpy as np
import pytest

from coordex.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, place string, block int, wins int"


def brute(rows, every=50, positives=5, negatives=3):
    """Plain Python integers, row by row."""
    able = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        able.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, (i, own, v) in enumerate(able):
        if i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j, lab) for m, (j, lab, w) in enumerate(able) if m != k)
        for s, j, _ in [r for r in ranked if r[2] == own][:positives]:
            inside = [r for r in ranked if r[2] != own and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(inside)]
    return sorted(out)


def mined(spark, table, **kw):
    df = spark.createDataFrame(table, SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some(n, labels, seed, wide=10, hot=0.4):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 2) for _ in range(wide)], 3 if rng.random() < hot else rng.randrange(labels), "x", 0, 0) for i in range(n)]


@pytest.mark.parametrize("sizes", [(7, 3, 4), (64, 16, 3)])
def test_small_blocks_equal_brute_force(spark, sizes):
    rows = some(160, 4, 1)
    b, a, c = sizes
    want = brute(rows, every=10)
    assert want and mined(spark, rows, every=10, rows=b, anchors=a, chunk=c) == want


def test_edges(spark):
    rows = some(60, 3, 2)
    rows += [(100, None, 1, "x", 0, 0), (150, [1.0, None], 1, None, 0, 0), (200, [math.nan], 1, "x", 0, 0), (250, [math.inf], 1, "x", 0, 0), (300, [1.0] * 10, None, "x", 0, 0), (None, [1.0] * 10, 1, "x", 0, 0)]
    rows += [(350, [], 1, "x", 0, 0), (400, [2.0, 2.0], 1, "x", 0, 0), (450, [1.0] * 12, 1, "y" * 100_000, 0, 0)]  # shorter and longer vectors
    rows += rows[:1] * 8 + rows[3:5] * 9 + [(0, rows[5][1], 2, "x", 0, 0)]  # repeated rows, an id with two vectors
    rows += [(k, rows[1][1], 2, "x", 0, 0) for k in range(500, 520)]  # ties
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [], every=10) == []
    assert mined(spark, rows[:1]) == []


def test_one_label_holds_all_or_each_row_has_its_own(spark):
    same = [(i, v, 1 if i % 7 else 0, *r) for i, v, _, *r in some(90, 1, 3)]
    assert mined(spark, same, every=10) == brute(same, every=10) == []
    apart = [(i, v, i * 11, *r) for i, v, _, *r in some(60, 1, 4)]
    assert mined(spark, apart, every=10, rows=8) == brute(apart, every=10)


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (1 << 8, 1 << 28):
        x, y = rng.integers(-top, top, (20, 9)), rng.integers(-top, top, (30, 9))
        assert H.product(x, y).tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]


def test_large_scores_and_too_large_ones(spark):
    rows = [(i, [float(v * 2**18) for v in e], lab, *r) for i, e, lab, *r in some(60, 2, 6)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, [1e30] * 4, 1, "x", 0, 0) for i in range(3)])


def test_what_moves_grows_with_the_rows(spark):
    """Panels are shuffled, and not the scores of every anchor and row."""
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    took = []
    for n in (600, 2400):
        before = moved()
        assert mined(spark, some(n, 5, 7, wide=4), every=1)
        took.append(moved() - before)
    assert 0 < took[1] < 6 * took[0]
