from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from causal_panel.llm import decontam, quality


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_base_counts(documents, odd, none, spark):
    edge = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "x\x0by\x0cz\u00a0w \U0001f600 é"), (3, "l\n\nl\n \nl#\n" * 4), (4, "a b c d"), (5, "q " * 5), (6, "q " * 6)], "doc_id long, text string")
    for frame in (documents, odd, edge):
        rows = frame.collect()
        found = quality.quality_rules(frame).collect()
        expected = sorted(str((r.doc_id, *slow_base(r.text))) for r in rows)
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found) == expected
        assert not any(r.kept and (r.base_failed or r.failed_rules) for r in found)
    assert quality.quality_rules(none).collect() == []


def test_no_python_in_the_plan(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_junk_goes_and_prose_stays(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").toPandas()
    assert found[(found["quality"] == 1) & (found["n_words"] >= 10)]["kept"].mean() > 0.99 and found[found["quality"] == 0]["kept"].mean() < 0.03


def slow_overlaps(text, items, least=13, similarity=0.8):
    words = re.findall(r"\w+", (text or "").lower())
    out = set()
    for i, item in items:
        item = re.findall(r"\w+", (item or "").lower())
        width = min(least, len(item))
        if not item:
            continue
        for p in range(len(words) - width + 1):
            for q in range(len(item) - width + 1):
                if sum(a == b for a, b in zip(words[p : p + width], item[q : q + width], strict=True)) >= similarity * width:
                    out.add(i)
                    break
            if i in out:
                break
    return out


def test_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    squash = lambda t: " ".join(t.lower().split())
    bench = [(r.item_id, squash(r.text)) for r in items.collect()]
    expected = {(d.doc_id, i) for d in docs.collect() for i, t in bench if t in squash(d.text)}
    found = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(docs, items).collect()}
    assert expected and found == expected
    kept = decontam.uncontaminated(docs, items, block_hashes=1000)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_substituted_words(spark):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(draw.choice(words) for _ in range(n))) for k, n in enumerate((5, 9, 13, 20, 40, 60, 3))]
    docs = []
    for k in range(60):
        item = items[k % 6][1].split()
        for j in range(draw.randrange(8), len(item), draw.choice((6, 8, 11))):  # a word in 6 to 11 is another
            item[j] = draw.choice(words)
        docs.append((k, " ".join([draw.choice(words) for _ in range(30)] + item + [draw.choice(words) for _ in range(10)])))
    docs += [(900 + k, " ".join(draw.choice(words) for _ in range(200))) for k in range(20)] + [(999, items[6][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(frame, bench).collect()}
    expected = {(i, j) for i, t in docs for j in slow_overlaps(t, items)}
    assert found == expected and len(found) > 40 and {x for x in found if x[0] >= 900} == {(999, 6)}
    assert found == {(r.doc_id, r.item_id) for r in decontam.find_overlaps(frame, bench, block_hashes=200).collect()}


def test_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "Three four FIVE six, seven"), (2, None), (3, ""), (4, "one two three four")], "item_id long, text string")
    found = decontam.find_overlaps(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in found) == [(6, 1, 2), (6, 1, 2), (6, 4, 0), (6, 4, 0)]
    assert decontam.find_overlaps(none, bench).collect() == [] == decontam.find_overlaps(odd, bench.filter("false")).collect()
    assert decontam.uncontaminated(odd, bench).count() == 6 and decontam.uncontaminated(odd, bench.filter("false")).count() == 8


def test_short_items_and_scripts_without_spaces(spark):
    """Items of one to four words are met as exact runs only; a Han, kana or Thai passage is met inside a longer clause, with a character changed."""
    passage = "今天天气很好我们去公园散步吧大家一起来"
    items = [(1, "Zyzzyva"), (2, "deep blue"), (3, "one small step"), (4, "to be or not"), (5, passage), (6, "สวัสดีครับผมชื่อสมชาย"), (7, "Быть или не быть"), (8, "?!")]
    docs = [(1, "a zyzzyva, here"), (2, "Deep BLUE."), (3, "one small leap"), (4, "to be or knot to be or not!"), (5, "他说" + passage.replace("公", "花") + "好吗"), (6, "คือสวัสดีครับผมชื่อสมชายนะ"), (7, "быть, или не быть?"), (8, "今天天气不好"), (9, "zyzzyvas"), (10, "?!")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 8):
        assert {(r.doc_id, r.item_id) for r in decontam.find_overlaps(frame, bench, block_hashes=size).collect()} == {(1, 1), (2, 2), (4, 4), (5, 5), (6, 6), (7, 7)}
        assert {r.doc_id for r in decontam.uncontaminated(frame, bench, block_hashes=size).collect()} == {3, 8, 9, 10}


def test_masks_miss_nothing():
    import itertools
    import math
    for n in range(5, 14):
        for wrong in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
            fits = [k for mask in decontam._masks_of(n) for k in range(n - len(mask) + 1) if all(c == "0" or k + j not in wrong for j, c in enumerate(mask))]
            assert fits, (n, wrong)
