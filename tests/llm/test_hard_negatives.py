"""Hard negatives against plain inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from caudal.llm import hard_negatives
from caudal.llm.hard_negatives import Packing

SCHEMA = "vec_id long, embedding array<float>, label int, _row string, score int"


def expected(rows, divisor=100, percent=80, positives=5, negatives=5, scale=256):
    """Ids here are unique, vectors of one size."""
    def sound(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = {i: ([math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and sound(v, label)}
    out = []
    for a, (va, la) in whole.items():
        if a % divisor:
            continue
        others = sorted(((-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in whole.items() if i != a), key=lambda t: t[:2])
        for score, positive, _ in [t for t in others if t[2] == la][:positives]:
            near = [t for t in others if t[2] != la and percent * -score <= 100 * -t[0] <= 100 * -score][:negatives]
            out += [(a, positive, k, i, -score, -s) for k, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives.hard_negatives(df, anchor, **more).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def test_packed_products_are_exact():
    random_numbers = np.random.default_rng(1)
    for size, bias in ((1, 0), (3, 5), (64, 160), (64, 1 << 25), (16, 3000)):
        packing = Packing(size, bias)
        vectors = random_numbers.integers(-bias, bias + 1, (50, size))
        vectors[0], vectors[1] = bias, -bias
        wide = [int.from_bytes(b, "little") for b in packing.pack(vectors)]
        for anchor in vectors[:5]:
            assert (packing.scores(anchor, wide, vectors.sum(axis=1)) == vectors @ anchor).all()


def test_random_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)  # labels in several blocks, and labels that share one
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 8)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)], rng.choice([0] * 6 + [1, 2, 3])) for i in range(150)]
    assert found(spark, rows, F.col("_id") % 10 == 0) == expected(rows, divisor=10)
    assert found(spark, rows, F.col("_id") % 10 == 0, positives=2, negatives=3, percent=50) == expected(rows, 10, 50, 2, 3)


def test_one_large_group_of_equal_vectors(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(300)] + [(1000 + i, [0.1 * i, -0.1], i % 5) for i in range(100)]
    assert found(spark, rows, F.col("_id") % 100 == 0) == expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 2), (5, [nan, 1.0], 2),
            (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (9, [0.0, 0.0], 1), (10, [1.0, 9.0], 2), (None, [1.0, 0.0], 1), (100, [0.0, 1.0], 3),
            (200, [-1.0, 0.0], 2), (11, [0.95, 0.0], 4), (12, [0.9, 0.0], 2)]
    assert found(spark, rows, F.col("_id") % 100 == 0) == expected(rows)
    other_size = [*rows, (20, [1.0], 2), (21, [], 2), (22, [1e30, 1.0], 2)]
    assert found(spark, other_size, F.col("_id") % 100 == 0) == expected(rows)
    twice = found(spark, [*rows, rows[0]], F.col("_id") % 100 == 0)
    assert twice.count((0, 0, 2, 11, 65536, 62208)) == 2  # each of the two is the other's positive
    assert found(spark, [], F.col("_id") % 100 == 0) == []
    assert found(spark, [(0, None, 1)], F.col("_id") % 100 == 0) == []


def test_text_labels(spark):
    df = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.9], "b")], "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 58880)]
