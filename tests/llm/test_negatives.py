"""Hard negatives against all pairs, on vectors with copies, ties, negative scores and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, page string, vec binary, ids array<long>, anchor boolean"


def brute(rows, k=5, low=80, high=100):
    seen = {}
    for r in rows:
        if None in r[:3] or any(x is None or not math.isfinite(x) for x in r[1]):
            continue
        seen[(r[0], r[2], tuple(math.floor(256 * x) for x in r[1]))] = None
    out = []
    for a, la, va in seen:
        if a % 10:
            continue
        scored = [(sum(x * y for x, y in zip(va, v, strict=True)), i, la == lab) for i, lab, v in seen if len(v) == len(va) and (i != a)]
        scored += [(sum(x * y for x, y in zip(va, v, strict=True)), i, False) for i, lab, v in seen if i == a and lab != la and len(v) == len(va)]
        for s, i, _ in sorted((x for x in scored if x[2]), key=lambda x: (-x[0], x[1]))[:k]:
            below = sorted((x for x in scored if not x[2] and low * s <= 100 * x[0] <= high * s), key=lambda x: (-x[0], x[1]))[:k]
            out += [(a, i, n + 1, b, s, t) for n, (t, b, _) in enumerate(below)]
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "p", b"v", [1], None) for r in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **more).collect()))


def vectors(seed, n, dim=6, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    out = []
    for i in range(n):
        v = centres[i % 4] + rng.standard_normal(dim) * rng.choice([0.02, 0.5])
        out.append([i, [float(x) for x in np.round(v, 3)], int(rng.integers(labels))])
    for i in range(0, n, 3):
        out[i][1] = out[0][1] if i % 2 else out[i % 5][1]
    return [tuple(r) for r in out]


def test_equals_all_pairs(spark):
    rows = vectors(1, 240) + vectors(2, 40, dim=3)[:40]
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(rows)]
    want = brute(rows)
    assert len(want) > 100 and found(spark, rows, page=8, anchor_page=1, sample=100) == want


def test_other_ranges_and_counts(spark):
    rows = [(i, v, lab) for i, (_, v, lab) in enumerate(vectors(4, 120))]
    assert found(spark, rows, low=50, high=150, positives=2, negatives=2, page=16, anchor_page=3) == brute(rows, k=2, low=50, high=150)


def test_edges(spark):
    one = [1.0, 0.5]
    rows = [
        (0, one, 1), (0, one, 1), (1, one, 1), (2, one, 1), (3, one, 2), (4, [0.9, 0.5], 2), (None, one, 1), (5, None, 1), (6, one, None), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 2),
        (9, [float("inf"), 0.0], 1), (10, [-1.0, 0.0], 3), (20, [0.0, 0.0], 4), (21, [0.0, 0.0], 4), (30, [], 5), (31, [], 5), (32, [], 6), (40, one, 7), (0, [0.8, 0.4], 2), (50, [1.0, 0.5, 0.25], 1),
    ]
    assert found(spark, rows, page=2) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, None, None)]) == []


def test_huge_components(spark):
    rows = [(i, [2.0**20 * (i % 7), 3.0 + i, float(2 ** (i % 40))], i % 3) for i in range(60)]
    assert found(spark, rows, page=8) == brute(rows)


def test_intervals_hold():
    rng = random.Random(5)
    import pyarrow as pa

    a, c = np.random.default_rng(1).standard_normal((2, 50, 8)) * 100
    row = {"x": 1}
    for side, m in (("a", a), ("c", c)):
        centre = m.mean(axis=0)
        row |= {f"{side}_centre": centre.tobytes(), f"{side}_radius": float(np.linalg.norm(m - centre, axis=1).max())}
    (out,) = negatives._intervals(iter([pa.RecordBatch.from_pylist([row])]))
    got = out.to_pylist()[0]
    assert rng and got["least"] <= (a @ c.T).min() and (a @ c.T).max() <= got["most"]


def test_nodes_are_pruned(spark):
    """Two far clusters: an anchor's page never meets the other cluster's pages."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (np.array([1.0, 0, 0, 0]) if i % 2 else np.array([0, 0, 0, 1.0])) + 0.01 * rng.standard_normal(4)], (i // 2) % 2) for i in range(400)]
    seen = []
    real = negatives._exact
    negatives._exact = lambda pairs, a, c, *more: seen.append(pairs.count() / (a.count() * c.count())) or real(pairs, a, c, *more)
    try:
        assert found(spark, rows, page=16, anchor_page=3) == brute(rows)
    finally:
        negatives._exact = real
    assert max(seen) <= 0.5
