"""Threshold-algorithm mining against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixdetect.llm import negatives
from mixdetect.llm.negatives import Block, Mining, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor_every, positives=5, k=5):
    """(anchor, positive, rank, negative, scores) by scoring all pairs of rows (id, vector, label)."""
    kept = []
    for i, v, label in {(i, None if v is None else tuple(v), label) for i, v, label in rows}:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, av, label in kept:
        if a % anchor_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, lab) for i, v, lab in kept if i != a)
        for ps, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and 80 * -ps <= 100 * -r[0] <= 100 * -ps][:k]
            out += [(a, p, n, i, -ps, -s) for n, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0, **kw).collect())


def random_rows(n, d, seed, coarse=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(coarse)) if coarse else (lambda: rng.gauss(0.05, 0.2))
    return [(i, [draw() for _ in range(d)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("coarse", [None, [0.0, 0.25, -0.25, 0.5]])
def test_equals_all_pairs(spark, coarse):
    rows = random_rows(160, 6, 5, coarse)  # coarse components: many equal scores
    assert mined(spark, rows) == brute(rows, 10)


def test_many_blocks_and_batches_change_nothing(spark, monkeypatch):
    rows = random_rows(150, 5, 8)
    want = brute(rows, 10)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 20)
    monkeypatch.setattr(negatives, "ANCHOR_BATCH", 4)
    assert mined(spark, rows) == want


def test_nulls_odd_numbers_ties_and_repeats(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, 2), (3, [0.45, 0.25], 2), (4, None, 2), (5, v, None), (None, v, 2),
            (6, [None, 0.5], 2), (7, [float("nan"), 0.5], 2), (8, [float("inf"), 0.5], 2), (9, v, 2), (20, [-0.5, -0.25], 1), (30, [0.0, 0.0], 3)]
    got = mined(spark, rows)
    assert got == brute(rows, 10)
    assert [(r[1], r[3]) for r in got if r[0] == 0] == [(1, 2), (1, 9), (1, 3)]


def test_shorter_and_empty_vectors_count_as_zeros(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.9], 2), (3, [], 2)]
    assert mined(spark, rows) == [(0, 1, 1, 2, 2 * 128 * 128, 128 * 230)]


def test_huge_components_stay_exact(spark):
    rows = [(0, [3e30, 1.0], 1), (1, [3e30, 2.0], 1), (2, [3e30, 0.5], 2)]
    s = negatives.SATURATION
    assert mined(spark, rows) == [(0, 1, 1, 2, s * s + 256 * 512, s * s + 256 * 128)]


def test_empty_table_extra_columns_and_no_anchor(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.col("id") % 10 == 0).count() == 0
    rows = random_rows(40, 4, 2)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "rid", "score", "block", "batch", "aid", "rank", "pids")})
    assert sorted(tuple(r) for r in negatives.mine(wide, F.col("id") % 10 == 0).collect()) == brute(rows, 10)
    assert negatives.mine(wide, F.col("id") < 0).count() == 0


def test_string_labels(spark):
    rows = random_rows(60, 4, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.concat(F.lit("l"), "label"))
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0).collect()) == brute(rows, 10)


def test_reading_stops_at_the_threshold():
    rng = np.random.default_rng(1)
    X = rng.integers(-20, 20, (5000, 3))
    X[7] = 200  # one row stands out: the others need not be read
    block = Block(np.arange(5000), np.arange(5000), np.zeros(5000, dtype=int), X)
    read = []
    whole = block.read

    def counted(anchor):
        for new, scores, threshold in whole(anchor):
            read.append(len(new))
            yield new, scores, threshold

    block.read = counted
    (at, scores), = search(block, np.array([1, 2, 3]), -1, 0, [None], True, 1)
    assert at.tolist() == [7] and scores.tolist() == [1200] and sum(read) < 200


def test_equal_scores_below_the_threshold_are_read():
    X = np.array([[5, 0]] * 40 + [[0, 5]] * 40)
    ids = np.arange(80)[::-1].copy()
    (at, _), = search(Block(ids, ids, np.zeros(80, dtype=int), X), np.array([1, 1]), -1, 0, [None], True, 3)
    assert sorted(ids[at]) == [0, 1, 2]


def test_other_numbers_of_partners(spark):
    rows = random_rows(80, 4, 9)
    assert mined(spark, rows, mining=Mining(positives=2, negatives=3)) == brute(rows, 10, 2, 3)
