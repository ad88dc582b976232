import math
import random

import pytest
from pyspark.sql import functions as F
from soundgrid.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, q string, _row string"


def brute(rows, every=50, k=5, n=3, least=50, most=95):
    valid = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        valid.append((i, [math.floor(256 * v) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (ai, ax, al) in enumerate(valid):
        if ai % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, bx)), bi, bl) for b, (bi, bx, bl) in enumerate(valid) if b != a)
        for ps, pi, _ in [s for s in scored if s[2] == al][:k]:
            window = [s for s in scored if s[2] != al and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:n]
            out += [(ai, pi, r + 1, ni, -ps, -ns) for r, (ns, ni, _) in enumerate(window)]
    return sorted(out)


def mined(spark, table, **sizes):
    df = spark.createDataFrame([(i, x and [v if v is None else float(v) for v in x], y, "q", "r") for i, x, y in table], SCHEMA)
    label = F.expr("IF(vec_id % 7 = 0, (CAST(label AS BIGINT) + 1) % 10, label)")
    out = hard_negatives.mine(df, F.expr("vec_id % 50 = 0"), label, sizes=hard_negatives.Sizes(**sizes))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dims, scale, seed, values=None):
    rnd = random.Random(seed)
    return [(k, [rnd.choice(values) if values else rnd.gauss(0, scale) for _ in range(dims)], rnd.randrange(3)) for k in range(n)]


@pytest.mark.parametrize("scale", [0.1, 2e3, 2e5])  # sums in 32 bits, in 64 bits, and in whole numbers
def test_against_brute_force(spark, scale):
    rows = vectors(220, 6, scale, 1)
    want = brute(rows)
    assert len(want) > 20 and mined(spark, rows) == want


def test_digits_of_score_and_id(spark):
    """Few values, so that scores tie; no window closes early."""
    rows = vectors(400, 2, 1, 2, [0.5, 0.75, 1.0])
    rows = [(k * 10 - 1000, x, y) for k, x, y in rows]
    assert mined(spark, rows, few=0, digit=3) == brute(rows) != []


def test_hot_copies_and_repeated_rows(spark):
    """A third of the rows are copies of one vector, some under the same vec_id; groups of rows and anchors are many."""
    rows = vectors(600, 4, 0.3, 3)
    rows = [(k, rows[0][1], y) if k % 3 == 0 else (k, x, y) for k, x, y in rows]
    rows += [rows[5]] * 4 + [rows[0]] * 90 + [rows[51]]
    assert mined(spark, rows) == brute(rows) != []


def test_many_cells(spark):
    rows = vectors(300, 4, 0.3, 4)
    assert mined(spark, rows, rows=50, anchors=2, at_once=60) == brute(rows) != []


def test_rows_that_take_no_part(spark):
    rows = vectors(120, 3, 0.4, 5)
    odd = [(None, [1.0, 1, 1], 1), (150, None, 1), (151, [1.0, None, 1], 1), (152, [float("nan"), 1, 1], 1), (153, [float("inf"), 1, 1], 1), (154, [1.0, 1, 1], None)]
    short = [(200, [0.5], 1), (201, [], 2), (202, [0.25, 0.5, 0.5, 0.5], 0)]
    big = [(203, [2.0**23, 1, 1], 1), (2**61, [1.0, 1, 1], 1)]
    want = brute(rows + short)
    assert mined(spark, rows + odd + short + big) == want != []


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert mined(spark, [(50, [1.0], 1), (2, [1.0], 2)]) == []  # no positive
    assert mined(spark, [(50, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]) == []  # no bound is met below zero
    assert mined(spark, [(50, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == [(50, 1, 1, 2, 0, 0)]
