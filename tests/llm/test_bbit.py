from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from causal_panel.llm import bbit


def slow_sets(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set() for w in split]


def slow_components(ids, sets):
    """Smallest id reachable, by all pairs; empty sets link with nothing."""
    root = list(range(len(sets)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=lambda k: ids[k])
            root[y] = x
    return [ids[find(k)] for k in range(len(sets))]


@pytest.fixture(scope="module")
def edited():
    """Texts with edited copies, whose similarities lie on both sides of 0.8, and chains of them."""
    draw, rows = random.Random(3), []
    for _ in range(60):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(8, 200))]
        for _ in range(5):
            rows.append(" ".join(words))
            words = [w if draw.random() > 0.05 else f"x{draw.randrange(90)}" for w in words]
    draw.shuffle(rows)
    return rows + ["", None, " \n", "one", "ONE", "one two", "two one", "é É", "É é"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def expected(texts):
    sets = slow_sets(texts)
    return {k: (len(s), c) for k, (s, c) in enumerate(zip(sets, slow_components(list(range(len(sets))), sets), strict=True))}


def test_against_brute_force(spark, edited):
    found = result(bbit.near_copies(frame(spark, edited)))
    assert found == expected(edited)
    assert sum(k != c for k, (_, c) in found.items()) > 60


def test_cut_proposals_and_buckets(spark, edited, monkeypatch):
    """Every proposal of over 100 shingles is cut into tiles, every bucket of over 2 sets is taken as it is: the same result."""
    monkeypatch.setattr(bbit, "LARGEST_BUCKET", 2)
    assert result(bbit.near_copies(frame(spark, edited), largest=100)) == expected(edited)


def test_estimate_is_corrected_for_chance():
    """The mean estimate over pairs of a known similarity is that similarity, and hardly any pair at the limit falls below the threshold."""
    draw = np.random.Generator(np.random.PCG64(1))
    for shared, each in ((0, 200), (100, 100), (180, 20), (240, 30)):
        found = []
        for _ in range(200):
            both, a, b = (draw.integers(0, 1 << 63, n, np.uint64) for n in (shared, each, each))
            x, y = (np.frombuffer(bbit.packed(bbit.minima(np.unique(np.concatenate([both, s])))), np.uint64)[None] for s in (a, b))
            found.append(float(bbit.estimate(x, y)[0]))
        assert abs(np.mean(found) - shared / (shared + 2 * each)) < 0.01
        if shared == 240:  # 0.8
            assert min(found) >= bbit.least_estimate()


def test_walk_visits_what_chains_reach():
    sets = [np.arange(k * 3, k * 3 + 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in range(40)]
    assert set(bbit.exact_groups([np.unique(s) for s in sets])) == {0}
    assert len(set(bbit.exact_groups([np.unique(s) for s in sets], percent=95))) == 40


def test_odd_rows(odd, none):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in bbit.near_copies(odd).collect()), key=str)
    n = len(slow_sets([" ".join(f"word{k % 997} other{k % 13}" for k in range(60_000))])[0])
    assert rows == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (5, n, 4), (6, 10, 6), (6, 10, 6), (None, 5, None)], key=str)
    assert bbit.near_copies(none).collect() == []
