from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causal_panel.llm import repeats


def slow(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone = [False] * len(d)
        end = 0
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                for j in range(max(k, end), k + 200):
                    gone[j] = True
                end = k + 200
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def check(df, largest_group=repeats.LARGEST_GROUP):
    rows = df.collect()
    expected = sorted((str(r.doc_id), *x) for r, x in zip(rows, slow([r.text for r in rows]), strict=True))
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df, largest_group=largest_group).collect())
    assert found == expected
    return found


@pytest.mark.parametrize("largest_group", [repeats.LARGEST_GROUP, 3])
def test_documents(documents, largest_group):
    assert sum(x[2] for x in check(documents, largest_group)) > 0


@pytest.mark.parametrize("largest_group", [repeats.LARGEST_GROUP, 2])
def test_planted(spark, largest_group):
    draw = random.Random(11)
    noise = lambda n: "".join(draw.choice("abcde é\n") for _ in range(n))
    passages = [noise(n) for n in (199, 200, 201, 230, 400, 1000)]
    rows = [(k, noise(draw.randrange(300)) + "".join(draw.choice(passages)[draw.randrange(40) :] + noise(draw.randrange(9)) for _ in range(4))) for k in range(40)]
    rows += [(90, "x" * 900), (91, "ab" * 400), (92, "x" * 199), (93, "x" * 300), (94, passages[2]), (95, passages[2][:200]), (None, passages[5]), (None, passages[5])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), largest_group)


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 256)
    monkeypatch.setattr(repeats, "_MASK", repeats.np.uint64(511))
    draw = random.Random(5)
    passage = "".join(draw.choice("abcdef") for _ in range(700))
    rows = [(k, "".join(draw.choice("abcdef") for _ in range(draw.randrange(600))) + passage[k * 9 :] * 2) for k in range(8)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(odd, none):
    found = check(odd.withColumn("text", F.substring("text", 1, 3000)))
    assert [x[2] for x in found if x[0] in ("4", "5")] == [3000, 3000]
    assert repeats.remove_repeats(none).collect() == []


def test_batches_are_released():
    """_compare gives out anchors before its input ends, in calls of a bounded size, and the same for any size of batches."""
    draw = random.Random(9)
    rows = []
    for anchor in range(-40, 40):
        text = bytes(draw.choice(b"abc") for _ in range(230))
        rows += [(anchor, 30 * 256 + 30, 1, anchor, k, 5, text[:210] + bytes(draw.choice(b"xyz") for _ in range(20))) for k in range(1 + anchor % 4)]
    whole = repeats.pa.Table.from_pylist([dict(zip(("anchor", "shape", "n", "k1", "k2", "at", "text"), r, strict=True)) for r in rows])

    def found(size):
        taken = []
        out = [(len(taken), b.num_rows, b.to_pylist()) for b in repeats._compare(taken.append(1) or x for x in whole.to_batches(max_chunksize=size))]
        return out, len(taken), sorted(tuple(r.values()) for _, _, part in out for r in part)

    expected = found(10**6)[2]
    assert expected
    for size in (1, 7, 50):
        out, n, spans = found(size)
        assert spans == expected and out[0][0] < n and len(out) > 2


def test_portions(monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 4)
    parts = list(repeats._portions(repeats.np.array([1, 1, 2, 2, 3, 4, 4, 4, 4, 4, 5])))
    assert parts == [(0, 4), (4, 5), (5, 10), (10, 11)] and list(repeats._portions(repeats.np.zeros(0))) == []
