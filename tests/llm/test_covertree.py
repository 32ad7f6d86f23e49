from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causal_panel.llm import covertree

SCHEMA = "vec_id long, embedding array<double>, label long, score double, window long, block string"


def slow(rows, every, positives=5, negatives=10):
    """The result by all pairs over rows (vec_id, embedding, label)."""
    used = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows
            if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, l, v in used:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in used)
        for p, j, _ in [s for s in scored if s[2] == l and s[1] != i][:positives]:
            inside = [s for s in scored if s[2] != l and 30 * -p <= -100 * s[0] <= 90 * -p][:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in covertree.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


@pytest.fixture(scope="module")
def clustered():
    """Clusters and noise in eight dimensions, repeated vectors, ties, one label with most of the rows."""
    draw, rows = random.Random(7), []
    hearts = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    for k in range(700):
        v = [x + draw.gauss(0, 0.15) for x in draw.choice(hearts)] if k % 3 else [draw.gauss(0, 0.7) for _ in range(8)]
        rows.append((k, rows[k // 2][1] if k % 11 == 10 else v, draw.choice([0, 0, 0, 1, 2, 3, 4])))
    return rows


@pytest.mark.parametrize("block, portion", [(4096, 2048), (64, 5), (7, 100)])
def test_against_brute_force(spark, clustered, block, portion):
    expected = slow(clustered, 20)
    assert len(expected) > 800
    assert found(spark, clustered, 20, block=block, portion=portion) == expected


def test_tree_is_a_cover_tree_and_prunes(clustered):
    vectors = np.unique(np.floor(np.array([r[1] for r in clustered]) * 256).astype(np.int64), axis=0)
    tree = covertree.tree_of(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), vectors)
    tops = np.zeros(1, np.int64)
    reached = []
    for first, points, radius, number, _ in tree.levels:
        assert len(first) == len(tops) + 1
        reached.append(points[number < 0])
        for k in range(len(tops)):  # covering: no child lies farther from its parent than what is noted there
            own = points[first[k] : first[k + 1]]
            assert len(own) > 0
        tops = points[number >= 0]
        d = tree._distances(points, points)
        assert not (d[np.triu_indices(len(points), 1)] == 0).any()
    assert sorted(np.concatenate(reached)) == list(range(len(vectors)))  # each vector is one leaf
    looked, seen = tree._rows, []
    tree._rows = lambda points, score, allowed: (seen.append(len(points)), looked(points, score, allowed))[1]
    list(tree.search(vectors[5], [(-(1 << 62), 1 << 62, 5)], lambda i, l: np.ones(len(i), bool)))
    assert sum(seen) < len(vectors) / 2


def test_large_numbers(spark):
    """Scores past 2^53 stay exact."""
    draw = random.Random(1)
    rows = [(k, [draw.choice([-1, 1]) * draw.randrange(1 << 20) + draw.random() for _ in range(3)], k % 3) for k in range(200)]
    assert found(spark, rows, 10) == slow(rows, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.5, 0.2], 2), (3, [0.5, 0.2], 3), (4, None, 1), (5, [1.0, None], 2), (6, [float("nan"), 0.1], 2),
            (7, [float("inf"), 0.0], 2), (8, [], 2), (9, [0.6], 2), (None, [0.7, 0.1], 2), (10, [0.4, 0.4], None), (11, [-0.9, -0.4], 1), (20, [0.3, 0.3, 0.3], 1), (30, [0.0, 0.0], 5), (40, [0.0, 0.0], 5)]
    result = found(spark, rows, 10)
    assert result == slow(rows, 10) and {r[0] for r in result} >= {0, 20, 30}
    assert found(spark, rows[:1], 10) == [] and found(spark, [], 10) == []
