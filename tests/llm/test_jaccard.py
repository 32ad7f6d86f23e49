from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from causal_panel.llm import jaccard


def slow_sets(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


def slow_groups(sets):
    """Smallest index that each set reaches by links of a similarity of 0.8 or more, by all pairs."""
    root = list(range(len(sets)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(sets))]


def check(df, stage):
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    expected = {rows[k].doc_id for k in slow_groups(slow_sets([r.text for r in rows]))}
    assert {r.doc_id for r in stage(df).collect()} == expected
    return len(rows) - len(expected)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_drops_what_brute_force_drops(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert check(docs, lambda d: corpus_pipeline.drop_near_copies(spark, d, "")) > 0


def test_recall_at_the_limit(spark):
    """Copies with one word in 50 or so changed: similarities on both sides of 0.8, most of them out of reach for a few bits of a fingerprint."""
    draw = random.Random(2)
    rows = []
    for _ in range(250):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 250))]
        rows.append(" ".join(words))
        for _ in range(2):
            rows.append(" ".join(w if draw.random() > 0.022 else "changed" for w in words))
    draw.shuffle(rows)
    assert check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), lambda d: corpus_pipeline.drop_near_copies(spark, d, "")) > 100


def test_groups_of_chains():
    """Sets that drift away from each other, so that groups of leaders must be merged over members."""
    draw = random.Random(5)
    for length, stride in ((40, 3), (30, 2), (20, 1), (25, 5)):
        sets = [frozenset(range(1000 * c + k * stride, 1000 * c + k * stride + length)) for c in range(3) for k in range(40) if draw.random() < 0.9]
        draw.shuffle(sets)
        assert jaccard.groups([np.array(sorted(s), np.uint64) for s in sets]) == slow_groups(sets)


def test_odd_rows(odd, none):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]
    assert jaccard.one_of_each(none).collect() == []


def test_later_stages_follow(spark, documents):
    """The stages after this one get what it keeps; the mix holds no two near copies."""
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    texts = [r.text for r in docs.collect()]
    assert slow_groups(slow_sets(texts)) == list(range(len(texts)))
    mixed = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert mixed and mixed <= {r.doc_id for r in docs.collect()}


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """op3's trie join is a step of this stage: without bands, copies with a word in some 400 changed still go."""
    draw = random.Random(9)
    rows = []
    for _ in range(20):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(380, 420))]
        rows += [" ".join(words), " ".join([*words[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "by_bands", lambda nodes: nodes.selectExpr("node as a", "node as b").filter("false"))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(0, 40, 2))
