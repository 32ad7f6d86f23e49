from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from causal_panel.llm import mixing
from causal_panel.llm.queries import source_weight


def slow_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check(df):
    rows = df.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    target = slow_targets(sizes)
    found = mixing.mix(df, source_weight()).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(3), source_weight()).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in found)
    return found


def test_documents(documents):
    check(documents)


def test_reduction_tree(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    monkeypatch.setattr(mixing, "FANOUT", 3)
    found = check(documents.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 7 > 0, F.col("source"))))
    part = [r for r in found if r.size and r.taken % r.size]
    assert len(part) <= len({r.source for r in found})


def test_pairs_keep_words_and_expectation():
    draw = np.random.default_rng(2)
    size = draw.integers(1, 500, 40).astype(float)
    part = draw.random(40)
    runs = np.array([mixing.round_pairs(part, size, draw.random(40))[0] for _ in range(4000)])
    assert np.allclose(runs @ size, part @ size)
    assert np.abs(runs.mean(0) - part).max() < 0.05
    assert ((runs > 0) & (runs < 1)).sum(1).max() <= 1


def test_odd_rows(odd, none):
    check(odd)
    assert mixing.mix(none, source_weight()).collect() == []
