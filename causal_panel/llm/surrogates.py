"""Surrogates for personal data: every entity gets a keyed stand-in of its own kind, the same one wherever it occurs.

Entities are found by patterns, reduced to what makes two mentions one entity (digits of a number, lower case of an address, each part of a
name), and given a surrogate drawn from a keyed hash: digits stay digits, letters letters of their script and case, names names of their
gender and script, punctuation and length of numbers stay. The checks run over the distinct entities of the whole corpus: two entities may not share a surrogate,
and none may be given what is another's real value. Where that happens all but one draw again, with a higher count, until none is left.
The count is 0 but for those few; texts that hold one of them get the counts by a join, all others are rewritten from the key alone.
"""
from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spare_name

#: Draws after which the values of a kind count as used up; the job then fails rather than merge two entities.
MOST_DRAWS = 64

_DIGIT = re.compile(r"\d")
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_CARD = re.compile(r"(?<![\d.])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\.?\d)")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?![\w])|(?<!\w)\+\d{8,15}(?!\w)")
#: Titles and given names by gender (f, m). Fixed values.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f"}
GIVEN = {
    "f": "Alice Anna Barbara Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Hannah Isabel Jane Jennifer Julia Karen Laura Linda Lucía Maria María Marie Mary Olivia Patricia Petra Sabine Sarah Sofía Sophie Susan Ursula Анна Елена Мария Ольга".split(),
    "m": "Andreas Antonio Carlos Charles Daniel David François Hans James Jean Joachim John José Juan Jürgen Klaus Luis Manuel Mark Michael Miguel Nicolas Paul Peter Pierre Richard Robert Stefan Thomas William Wolfgang Алексей Дмитрий Иван Сергей".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
#: Combining marks and joiners, which many scripts write inside a name.
_MARKS = "".join(re.escape(chr(c)) for c in range(0x300, 0x12000) if unicodedata.category(chr(c)) in ("Mn", "Mc")) + "\u200c\u200d"
_CAPITALISED = rf"[^\W\d_a-zà-ÿ](?:[{_MARKS}]*[^\W\d_])+[{_MARKS}]*"
_NAME = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(map(re.escape, TITLES))})\.? (?P<titled>{_CAPITALISED}(?:[ \-]{_CAPITALISED}){{0,2}})|(?P<given>{'|'.join(map(re.escape, GENDER))}) (?P<family>{_CAPITALISED}(?:-{_CAPITALISED})?))(?![\w{_MARKS}])")
#: Syllables for names by script, and endings by gender. Fixed values.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vo wa we".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зе зо ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те то".split(),
    "greek": "βα βε βο γα γο δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": {"f": "lia na ra".split(), "m": "nus lor ren".split(), "": "ley ner son".split()}, "cyrillic": {"f": "лия на ра".split(), "m": "нор лен рис".split(), "": "нов ров ман".split()}, "greek": {"f": "λια να ρα".split(), "m": "νος λος ρης".split(), "": "νου ρου λης".split()}}


class Draws:
    """A stream of numbers that follows from the key and a label."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.count, self.pool = key, label.encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.count.to_bytes(4, "big") + self.label, hashlib.sha512).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def _script(text: str) -> str:
    c = ord(text[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin" if c < 0x250 or 0x1E00 <= c < 0x1F00 else "other"


def _like(c: str, draws: Draws) -> str:
    """A character of the same class."""
    if c.isdecimal():
        return chr(ord(c) - int(c) + draws.below(10))
    if "a" <= c <= "z":
        return chr(97 + draws.below(26))
    if "A" <= c <= "Z":
        return chr(65 + draws.below(26))
    if "一" <= c <= "鿿":
        return chr(0x4E00 + draws.below(20000))
    alike = _letters().get(_kin(c), c) if c.isalpha() else c
    return alike[draws.below(len(alike))]


def _kin(c: str) -> tuple[str, str, bool]:
    """What letters of one script, case and form have in common: the first word of the name, the category, whether it is a plain form."""
    return unicodedata.name(c, "").partition(" ")[0], unicodedata.category(c), unicodedata.is_normalized("NFKC", c)


@cache
def _letters() -> dict[tuple[str, str, bool], str]:
    """All letters by kin."""
    kin: dict[tuple[str, str, bool], list[str]] = {}
    for c in map(chr, range(0x80, 0x20000)):
        if c.isalpha() and c.lower() == c:
            kin.setdefault(_kin(c), []).append(c)
    return {k: "".join(v) for k, v in kin.items()}


def _drawable(text: str) -> bool:
    """Whether `_like` can change anything of a text."""
    return any(c.isdecimal() or c.isalpha() and (c.isascii() or "一" <= c <= "鿿" or len(_letters().get(_kin(c), "")) > 1) for c in text)


def _luhn(digits: str) -> int:
    """The check digit that `digits` without its last one calls for."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits[:-1])))
    return -total % 10


def surrogate_of(key: bytes, kind: str, value: str, draw: int) -> str:
    """The stand-in of an entity's value (in its reduced form), at the draw-th attempt."""
    draws = Draws(key, f"{kind}\0{draw}\0{value}")
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        by_domain = Draws(key, f"domain\0{host}" if _drawable(local) else f"domain\0{draw}\0{host}")  # addresses of one domain keep one domain
        return "".join(_like(c, draws) for c in local) + "@" + "".join(_like(c, by_domain) for c in host) + "." + top
    if kind == "ip":
        return ".".join(str(draws.below(254) + 1) for _ in range(4))
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", value)
        digits = "0123456789ABCDEF" if value.isupper() else "0123456789abcdef"
        lead = 0 if hexadecimal else len(re.match(r"AKIA|[a-z]+[-_]", value)[0])
        return value[:lead] + "".join(digits[draws.below(16)] if hexadecimal else _like(c, draws) for c in value[lead:])
    if kind in ("family", "given-f", "given-m", "given-"):
        script = _script(value)
        if script == "other":
            letter = next(filter(_drawable, value))
            return "".join(_like(c, draws) for c in value) + "".join(_like(letter, draws) for _ in range(draw // 4))
        gender = kind[6:] if kind.startswith("given") else ""
        stem = "".join(SYLLABLES[script][draws.below(len(SYLLABLES[script]))] for _ in range(2 + (draws.below(2) if kind == "family" else 0) + draw // 4))
        return stem + ENDINGS[script][gender][draws.below(3)]
    if kind == "card":
        drawn = str(1 + draws.below(9)) + "".join(str(draws.below(10)) for _ in value[1:])
        return drawn[:-1] + str(_luhn(drawn)) if value[-1] == str(_luhn(value)) else drawn
    if kind == "phone" and value[0] == "+":  # the country code is not told apart; its first digit stays
        return value[:2] + "".join(str(draws.below(10)) for _ in value[2:])
    if kind == "iban":
        return value[:2] + "".join(_like(c, draws) for c in value[2:])
    return "".join(_like(c, draws) for c in value)


def _ip(text: str) -> bool:
    try:
        return bool(ipaddress.IPv4Address(text))
    except ValueError:
        return False


def _phone(text: str) -> bool:
    """Seven to fifteen digits with a country code, an area code in brackets, the form 555-1234, or three groups of nine digits or more."""
    n, groups = sum(map(str.isdigit, text)), len(re.findall(r"\d+", text))
    return 7 <= n <= 15 and (text[0] in "+(" or groups >= 3 and n >= 9 or bool(re.fullmatch(r"\d{3}[\-.]\d{4}", text)))


def _digits(text: str) -> str:
    return ("+" if text[0] == "+" else "") + "".join(c for c in text if c.isalnum())


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, reduced value) of each entity of a text, in order and without overlaps. Of a name, each part is an entity."""
    found: list[tuple[int, int, str, str]] = []
    rest = text  # with what is found blotted out, so that no later pattern runs into it

    def take(pattern: re.Pattern, kind: str, reduce: Callable[[str], str], fits: Callable[[str], bool] = lambda _: True) -> None:
        nonlocal rest
        for m in pattern.finditer(rest):
            if fits(m[0]):
                found.append((m.start(), m.end(), kind, reduce(m[0])))
                rest = rest[: m.start()] + "\0" * (m.end() - m.start()) + rest[m.end() :]

    if "@" in text:
        take(_EMAIL, "email", str.lower, lambda s: _drawable(s.rpartition(".")[0]))
    take(_SECRET, "secret", str, lambda s: _drawable(re.sub(r"^[a-z]+[-_]", "", s)))
    if _DIGIT.search(text):
        take(_IP, "ip", str, _ip)
        take(_IBAN, "iban", lambda s: s.replace(" ", ""))
        take(_CARD, "card", _digits, lambda s: 13 <= sum(map(str.isdigit, s)) <= 19)
        take(_SSN, "ssn", _digits)
        take(_PHONE, "phone", _digits, _phone)
    for m in _NAME.finditer(text):
        group, gender = ("titled", TITLES[m["title"]]) if m["title"] else ("family", GENDER[m["given"]])
        words = [(m.start(group) + w.start(), w[0]) for w in re.finditer(r"[^ ]+", m[group])]
        if m["given"]:
            words.insert(0, (m.start("given"), m["given"]))
        for k, (start, word) in enumerate(words):  # the first of several is a given name; double names are an entity a part
            kind = f"given-{GENDER.get(word, gender)}" if k == 0 and len(words) > 1 else "family"
            found += [(start + p.start(), start + p.end(), kind, p[0].lower()) for p in re.finditer(r"[^\-]+", word) if _script(p[0]) != "other" or _drawable(p[0].lower())]
    kept, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


def dressed(shape: str, kind: str, surrogate: str) -> str:
    """The surrogate in the form of the mention: its punctuation for numbers, its case for words."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(surrogate.lstrip("+"))
        return "".join(next(rest, c) if c.isalnum() else c for c in shape)
    if kind in ("ip", "secret"):
        return surrogate
    if kind == "email":
        return surrogate.upper() if shape.isupper() else "".join(s.upper() if c.isupper() else s for c, s in zip(shape, surrogate, strict=True))
    return surrogate.upper() if shape.isupper() and len(shape) > 1 else surrogate.capitalize()


def rewrite(text: str, key: bytes, counts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """A text with its entities replaced, and their number. counts: draws of entities that needed more than one."""
    found, parts, end = mentions(text), [], 0
    for a, b, kind, value in found:
        parts += [text[end:a], dressed(text[a:b], kind, surrogate_of(key, kind, value, counts.get((kind, value), 0)))]
        end = b
    return "".join([*parts, text[end:]]), len(found)


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(n, k, v) for n, t in zip(batch["name"], batch["text"], strict=True) if t for k, v in sorted({x[2:] for x in mentions(t)})]
        yield pd.DataFrame(rows, columns=["name", "kind", "value"])


def settle_draws(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, draw) of the entities (kind, value; distinct) that need more than one draw, so that all surrogates of a kind differ
    from each other and from every real value."""
    surrogate = F.pandas_udf(
        lambda kind, value, draw: pd.Series([surrogate_of(key, *x) for x in zip(kind, value, draw, strict=True)], dtype=object), "string")
    now = entities.withColumn("draw", F.lit(0))
    for _ in range(MOST_DRAWS):
        given = settle(now.withColumn("surrogate", surrogate("kind", "value", "draw")), "surrogates")
        first = given.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("draw", "value")).alias("first")).filter("n > 1")
        shared = given.join(first, ["kind", "surrogate"]).filter(F.struct("draw", "value") != F.col("first")).select("kind", "value")
        real = given.join(entities.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "value")
        again = settle(shared.unionByName(real).distinct().withColumn("more", F.lit(1)), "collisions")
        if again.isEmpty():
            return given.filter("draw > 0").select("kind", "value", "draw")
        now = given.drop("surrogate").join(again, ["kind", "value"], "left").select("kind", "value", (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw"))
    raise ValueError(f"some entities share a surrogate after {MOST_DRAWS} draws: their format has too few values")


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`docs` with its columns, `text_col` rewritten; `count_col`, if named, is added with the number of mentions replaced.

    Null stays null (0 mentions), texts without entities stay as they are. Repeated rows and equal entities anywhere get equal surrogates.
    Names of other columns don't matter unless one is `count_col`, which is then replaced. An empty table stays empty.
    """
    named = docs.select(F.xxhash64(F.col(text_col)).alias("name"), F.col(text_col).alias("text"))
    found = named.mapInPandas(_entities, "name long, kind string, value string")
    draws = settle(settle_draws(settle(found.select("kind", "value").distinct(), "entities"), key), "draws")
    result, new = "text string, n int", spare_name(docs, "_rewritten")
    if draws.isEmpty():
        @F.pandas_udf(result)
        def replaced(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(t, 0) if t is None else rewrite(t, key, {}) for t in texts], columns=["text", "n"])

        out, drop = docs.withColumn(new, replaced(F.col(text_col))), [new]
    else:  # texts with an entity that needed another draw, by their hash
        name, more = spare_name(docs, "_name"), spare_name(docs, "_draws")
        held = found.join(draws, ["kind", "value"]).distinct().groupBy("name").agg(F.collect_list(F.struct("kind", "value", "draw")).alias(more))
        held = settle(held, "redrawn").withColumnRenamed("name", name)

        @F.pandas_udf(result)
        def replaced(texts: pd.Series, draws: pd.Series) -> pd.DataFrame:
            rows = [(t, 0) if t is None else rewrite(t, key, {} if d is None else {(x["kind"], x["value"]): x["draw"] for x in d}) for t, d in zip(texts, draws, strict=True)]
            return pd.DataFrame(rows, columns=["text", "n"])

        out = docs.join(held, F.xxhash64(F.col(text_col)) == F.col(name), "left").withColumn(new, replaced(F.col(text_col), F.col(more)))
        drop = [new, name, more]
    out = out.withColumn(text_col, F.col(f"{new}.text"))
    return (out.withColumn(count_col, F.col(f"{new}.n").cast("long")) if count_col else out).drop(*drop)
