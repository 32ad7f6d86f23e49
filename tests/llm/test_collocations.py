from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from causal_panel.llm import collocations as c


def slow(rows, least, top=2000):
    """The result by plain counting over rows (text, lang)."""
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in often.items():
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if len(p) > 1 and not any(100 * b >= 80 * a for b in longer):
                s, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, q, n[lang], -s) for r, (s, a, p, l, q) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(spark, rows, least, **more):
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "text string, lang string, f long, word string, n int")
    return sorted(tuple(r) for r in c.collocations(df, least=least, **more).collect())


@pytest.fixture(scope="module")
def texts():
    draw, rows = random.Random(4), []
    fixed = ["New York City hall", "so to speak", "São Paulo", "the end of the day"]
    for k in range(400):
        words = [draw.choice(fixed) if draw.random() < 0.2 else f"w{int(draw.paretovariate(0.8))}" + draw.choice(["", "", ",", ".", "\n"]) for _ in range(draw.randrange(1, 60))]
        rows.append(((" " if k % 5 else "\t ").join(words), draw.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("more", [{}, {"held": 50}, {"most_words": 0}])
def test_against_brute_force(spark, texts, more):
    """Also with filters of 50 entries, and with the dictionary joined instead of sent."""
    expected = slow(texts, 5)
    assert len(expected) > 100
    assert found(spark, texts, 5, **more) == expected


def test_unpruned_and_sharded(spark, texts, monkeypatch):
    monkeypatch.setattr(c, "MOST_KNOWN", 3)
    monkeypatch.setattr(c, "SHARD", 100)
    assert found(spark, texts, 5, top=7) == slow(texts, 5, 7)


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 7), (4, 16), (4, 21), (2, 31), (4, 31)])
def test_filters_lose_nothing(n, bits):
    draw = np.random.Generator(np.random.PCG64(n * bits))
    grams = draw.integers(1, 1 << bits, (3000, n))
    left, right = c.pack(grams, bits)
    assert (c.unpack(left, right, n, bits) == grams).all()
    a, b = c.permute(left, right, n, bits)
    x, y = c.restore(a, b, n, bits)
    assert (x == left).all() and (y == right).all()
    count = draw.choice([1, 2, 254, 255, 256, 1 << 40], len(a))
    numbers = c.summed(a, b, count)
    assert numbers[2].sum() == count.sum()
    data = c.encode(*numbers, *c.lanes(n, bits))
    for old, new in zip(numbers, c.decode(data, *c.lanes(n, bits)), strict=True):
        assert (old == new).all()
    if (n, bits) == (4, 16):
        assert len(c.encode(numbers[0], numbers[1], np.ones(len(numbers[0]), np.int64), *c.lanes(n, bits))) < 11 * 4096


def test_odd_rows(spark, odd, none):
    long_text = "very long text " * 50_000
    rows = [(None, "en"), ("", "en"), (" \t\n", None), (long_text, "en"), ("very long text", "en"), ("very long text", "en"), ("very\0odd", None), ("...", "de"), ("é É", "und")]
    assert found(spark, rows, 2) == slow(rows, 2)
    assert found(spark, [], 2) == []
    assert c.collocations(none, lang_col="source").collect() == []
    again = c.collocations(odd, lang_col="source").collect()
    assert again == c.collocations(odd, lang_col="source").collect() or len(again) > 0
