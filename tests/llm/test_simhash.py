from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from causal_panel.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def slow_components(ids, fps, budget=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= budget:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least.setdefault(find(k), []).append(i)
    return [min(x for x in least[find(k)] if x is not None) if any(x is not None for x in least[find(k)]) else None for k in range(len(ids))]


def test_matches_brute_force(documents, texts):
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    assert [found[i][0] & (1 << 64) - 1 for i in ids] == fps
    assert [found[i][1] for i in ids] == slow_components(ids, fps)


@pytest.mark.parametrize("top", [0, 3])
def test_forest_of_clustered_numbers(top):
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(12)]
    values = np.unique(np.array([c ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(6))) & (1 << 64) - 1 for c in centres for _ in range(60)], np.uint64))
    links = []
    for turned in (0, 32):
        v = np.sort(values << np.uint64(turned) | values >> np.uint64(64 - turned)) if turned else values
        back = v << np.uint64(32) | v >> np.uint64(32) if turned else v
        for own in range(1 << top):
            root = simhash.forest(v, top, own)
            links += [(int(back[a]), int(back[b])) for a, b in enumerate(root.tolist()) if a != b]
    at = {int(x): k for k, x in enumerate(values)}
    root = simhash._roots(np.arange(len(values)), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert all(bin(a ^ b).count("1") <= 64 for a, b in links)
    least = slow_components(list(range(len(values))), [int(x) for x in values])
    assert root.tolist() == least


def test_prefixes_are_walked_by_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEAN_NODE", 8)
    draw = random.Random(3)
    rows = [(draw.getrandbits(64) - (1 << 63),) for _ in range(150)]
    rows += [((v & (1 << 63) - 1 ^ 1 << draw.randrange(60) ^ 1 << draw.randrange(60)) | v & -(1 << 63),) for (v,) in rows[:70]]
    nodes = spark.createDataFrame(rows, "fp long").distinct()
    roots = {r.node: r.root for r in simhash.connect(simhash.links(nodes)).collect()}
    fps = sorted(r.fp for r in nodes.collect())
    assert [roots.get(f, f) for f in fps] == slow_components(fps, fps)


def test_prefixes_grow_while_a_node_is_crowded(spark, monkeypatch):
    """Fingerprints that share their first 26 bits and more: prefixes grow past them."""
    monkeypatch.setattr(simhash, "MEAN_NODE", 64)
    monkeypatch.setattr(simhash, "LARGEST_NODE", 12)
    draw = random.Random(6)
    rows = {(0x2B5 << 54 | draw.getrandbits(6) << 32 | draw.getrandbits(32),) for _ in range(120)}
    rows |= {(v ^ 1 << draw.randrange(60) ^ 1 << draw.randrange(60) ^ 1 << draw.randrange(60),) for (v,) in sorted(rows)[:60]}
    nodes = spark.createDataFrame([(v - (1 << 63),) for (v,) in sorted(rows)], "fp long").distinct()
    roots = {r.node: r.root for r in simhash.connect(simhash.links(nodes)).collect()}
    fps = sorted(r.fp for r in nodes.collect())
    assert [roots.get(f, f) for f in fps] == slow_components(fps, fps)


def test_connect_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 901), (905, 901)], "a long, b long"))
    roots = {r.node: r.root for r in simhash.connect(edges).collect()}
    assert roots == {k: 0 for k in range(201)} | {900: 900, 901: 900, 905: 900}


def test_odd_rows(odd, none):
    found = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert [x[2] for x in found if x[0] in "123"] == [1, 1, 1] and [x[1] for x in found if x[0] in "123"] == [0, 0, 0]
    assert [x[2] for x in found if x[0] in "45"] == [4, 4] and len(found) == 8
    assert [x[2] for x in found if x[0] == "None"] == [None]
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]
