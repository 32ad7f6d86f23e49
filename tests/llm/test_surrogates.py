from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from causal_panel.llm import surrogates as s

KEY = b"k"
TEXT = (
    "Dr. Smith met Anna Smith; Herr Smith-Meier rang +1 (017) 555-7713 190.137.2.4 and wrote Bob.X@Mail.example.com or bob.x@mail.example.com. "
    'Card 4111 1111 1111 1111, 4111-1111-1111-1111, id 123-45-6789, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", г-жа Иванова, 2019-2020, v1.2.3.4.5.'
)


def test_kinds_and_coreference():
    found = s.mentions(TEXT)
    assert [x[2] for x in found] == ["family", "given-f", "family", "family", "family", "phone", "ip", "email", "email", "card", "card", "ssn", "secret", "family"]
    new, n = s.rewrite(TEXT, KEY, {})
    assert n == len(found) and all(TEXT[a:b] not in new for a, b, k, _ in found)
    names = re.match(r"Dr\. (\w+) met (\w+) (\w+); Herr (\w+)-\w+ rang \+1 \(\d{3}\) \d{3}-\d{4} ", new)
    assert names[1] == names[3] == names[4] and names[2].endswith(("lia", "na", "ra"))
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0].lower() == mails[1].rstrip(".").lower() and mails[0][0].isupper() and mails[0].endswith(".com")
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", new)
    digits = cards[0].replace(" ", "")
    assert digits == cards[1].replace("-", "") and int(digits[-1]) == s._luhn(digits)
    assert re.search(r"г-жа [А-Я][а-я]+,", new) and "2019-2020, v1.2.3.4.5." in new
    assert s.rewrite(TEXT, b"other", {})[0] != new


def test_documents(documents, texts):
    found = {r.doc_id: r for r in s.replace_entities(documents, KEY, count_col="n").collect()}
    hits = 0
    for i, text in texts.items():
        values = s.mentions(text)
        hits += len(values)
        assert found[i].n == len(values)
        if not values:
            assert found[i].text == text
        for a, b, kind, _ in values:
            assert kind.startswith(("family", "given")) or text[a:b] not in found[i].text
    assert hits > 10
    assert not any(re.search(r"@mail\d\.example\.com|555-\d{4}", r.text) for r in found.values())


def test_collisions_draw_again(spark, monkeypatch):
    """Numbers of one digit that matters: surrogates collide, the checks part them, and none is another's real value."""
    real = s.surrogate_of
    monkeypatch.setattr(s, "surrogate_of", lambda key, kind, value, draw: real(key, kind, value, draw)[:3].lower() + value[3:] if kind == "family" else real(key, kind, value, draw))
    names = [a + b + "x" for a in "ABCDEFGH" for b in "aeiou"]
    docs = spark.createDataFrame([(k, f"Mr {n} and again Herr {n}.") for k, n in enumerate(names)], "doc_id long, text string")
    out = s.replace_entities(docs, KEY).collect()
    given = {}
    for r in out:
        a, b = re.fullmatch(r"Mr (\w+) and again Herr (\w+)\.", r.text).groups()
        assert a == b
        given[names[r.doc_id]] = a
    assert len(set(given.values())) == len(names) and not set(given.values()) & set(names)


def test_used_up(spark):
    entities = spark.createDataFrame([("other", str(k)) for k in range(10)], "kind string, value string")
    with pytest.raises(ValueError, match="too few values"):
        s.settle_draws(entities, KEY)


def test_odd_rows(odd, none):
    wide = odd.withColumns({c: F.lit("kept") for c in ("n", "_rewritten", "_name", "_draws", "_id", "_text", "_kept")})
    out = s.replace_entities(wide, KEY)
    assert out.columns == wide.columns and {r["_rewritten"] for r in out.collect()} == {"kept"}
    assert sorted(map(str, out.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert s.replace_entities(none, KEY, count_col="n").collect() == []


NAMES = ["محمد", "כהן", "김민수", "さくら", "タナカ", "शर्मा", "გიორგი", "Պետրոս", "สมชาย", "王小明", "Ｔａｎａｋａ"]


def test_names_of_any_script(spark):
    docs = spark.createDataFrame([(k, f"Dr. {n} met Mr {n}, and Frau {n}-{n}.") for k, n in enumerate(NAMES)], "doc_id long, text string")
    for r in s.replace_entities(docs, KEY, count_col="n").collect():
        name = NAMES[r.doc_id]
        given = re.fullmatch(r"Dr\. (\S+) met Mr (\S+), and Frau (\S+)-(\S+)\.", r.text).groups()
        assert r.n == 4 and len(set(given)) == 1 and given[0].lower() != name.lower() and name not in r.text
        scripts = [{s.unicodedata.name(c).split()[0] for c in x if c.isalpha()} for x in (name, given[0])]
        assert scripts[0] == scripts[1]


def test_nothing_to_redraw(spark):
    texts = ["see -@-.- and sk-" + "-" * 16, "-@a.de -@b.de -@c.de -@d.de " * 2]
    found = {r.doc_id: r for r in s.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY, count_col="n").collect()}
    assert found[0].n == 0 and found[0].text == texts[0]
    assert found[1].n == 8 and len(set(found[1].text.split())) == 4 and not set(found[1].text.split()) & set(texts[1].split())
