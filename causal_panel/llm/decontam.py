"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that ignores some of them, so it meets a passage although a word under an ignored place was
changed. All masks are hashed at every word of the benchmark items and of the documents; where hashes join, the item is laid over the
document at that place, and the pair counts if some `least_words` neighbouring words of the item (the whole item if it is shorter) agree in
`similarity` of their places.

The benchmark is the stated query set: its hashes are taken in blocks of a bounded size, each broadcast and held against all documents
in one scan, one block at a time. No document is shuffled.
"""
from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import settle

#: An item of fewer words than `WHOLE` is found only as an exact run; one of more than `LEAST_WORDS` needs so many words together.
WHOLE, LEAST_WORDS, SIMILARITY = 5, 13, 0.8
#: Which words a seed reads (1) and ignores (0). Wherever two of 13 words in a row differ, one of the first pair still fits between them;
#: the others do so for items of 5 to 12 words at a similarity of 0.8. So with these parameters no overlap is missed.
MASKS, SHORT_MASKS = ("11101011", "11001111"), ("1111", "11011", "10111", "11101")
#: Seed hashes in a block of the benchmark (about 50 MB with the words of the items).
BLOCK_HASHES = 1 << 20
#: Scripts written without spaces (kana, Han, Thai, Lao, Myanmar, Khmer): there each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: The same in Spark, to size blocks.
_COUNTED = r"[\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]|(?U:\w)+"


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each word, lower-cased and without punctuation. `known` is a cache."""
    words = WORDS.findall(text.lower()) if text else []
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at every place where it fits."""
    n = len(words) - len(mask) + 1
    total = np.full(max(n, 0), int(mask, 2) | len(mask) << 16, np.uint64)
    for k in range(len(mask)) if n > 0 else ():
        if mask[k] == "1":
            total = (total ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
    return total


def _masks_of(n: int) -> tuple[str, ...]:
    return MASKS if n >= LEAST_WORDS else SHORT_MASKS if n >= WHOLE else ("1" * n,)


class Block:
    """Some benchmark items with the sorted hashes of their seeds."""

    def __init__(self, items: list[tuple]):
        cache: dict[str, int] = {}
        self.items = [(i, words) for i, text in items if len(words := word_hashes(text, cache))]
        found, self.masks = [], set()
        for k, (_, words) in enumerate(self.items):
            for mask in _masks_of(len(words)):
                self.masks.add(mask)
                hashed = seeds(words, mask)
                found.append(np.stack([hashed, np.full(len(hashed), k, np.uint64), np.arange(len(hashed), dtype=np.uint64)]))
        self.masks = sorted(self.masks)
        table = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
        self.hashes, self.item, self.place = table[:, np.argsort(table[0], kind="stable")]
        self.bits = max(10, int(len(self.hashes)).bit_length() + 5)  # a first filter by the hash's low bits
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.hashes & np.uint64((1 << self.bits) - 1)] = True

    def overlaps(self, words: np.ndarray, least_words: int, similarity: float) -> list[tuple]:
        """(item id, words that agree, first word, share that agrees) of each item found in a document, at its best place."""
        lines = set()
        for mask in self.masks:
            hashed = seeds(words, mask)
            at = np.flatnonzero(self.maybe[hashed & np.uint64((1 << self.bits) - 1)])
            left, right = (np.searchsorted(self.hashes, hashed[at], side) for side in ("left", "right"))
            for p, a, b in zip(at[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist(), strict=True):
                lines.update(zip(self.item[a:b].tolist(), (p - self.place[a:b].astype(np.int64)).tolist(), strict=True))
        best: dict[int, tuple] = {}
        for k, shift in sorted(lines):
            item = self.items[k][1]
            a, b = max(0, -shift), min(len(item), len(words) - shift)
            width = min(least_words, len(item))
            if b - a < width:
                continue
            equal = item[a:b] == words[a + shift : b + shift]
            sums = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(sums[width:] - sums[:-width] >= similarity * width - 1e-9)
            if len(good):
                covered = np.zeros(b - a, bool)
                for g in good.tolist():
                    covered[g : g + width] = True
                found = (int((equal & covered).sum()), -(a + shift + int(good[0])), float((equal & covered).sum() / covered.sum()))
                best[k] = max(best.get(k, found), found)
        return [(self.items[k][0], agreed, -first, part) for k, (agreed, first, part) in best.items()]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_hashes: int):
    """The benchmark as broadcast blocks of about `block_hashes` hashes, and whether a block is the only one; each item is in one of them.

    With several, a block is gone when the next is asked for, so its result must be settled by then.
    """
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    n_words = items.agg(F.sum(F.regexp_count("t", F.lit(_COUNTED)))).first()[0] or 0
    blocks = max(1, -(-n_words * len(SHORT_MASKS) // block_hashes))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        block = benchmark.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in rows]))
        del rows
        yield block, blocks == 1
        if blocks > 1:
            block.destroy()


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """(`id_col`, `item_col`, n_words, first_word, agreement): one row per document and benchmark item found in it.

    n_words counts the document's words that agree with the item at the best place, first_word is where they begin. Null and empty
    texts, and items without a word, meet nothing; an item of under `WHOLE` words is found where it stands as it is. Repeated rows are found each. Other columns are left out.
    An empty benchmark or table of documents gives an empty result.
    """
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField(item_col, item_type), T.StructField("n_words", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("agreement", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def search_in(block):
        def search(batches):
            known: dict[str, int] = {}
            for batch in batches:
                found = []
                for i, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                    found += [(i, *x) for x in block.value.overlaps(word_hashes(text.as_py(), known), least_words, similarity)]
                    if len(known) > 500_000:
                        known.clear()
                columns = zip(*found, strict=True) if found else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        return search

    parts = []
    for block, alone in _blocks(benchmark, item_col, item_text, block_hashes):
        found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(search_in(block), schema)
        parts.append(found if alone else settle(found, "overlaps"))
    return reduce(DataFrame.unionByName, parts)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                   least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """`docs` with its columns, less the documents in which a benchmark item is found. Texts are judged in the scan; nothing is shuffled."""

    def clean_of(block):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            known: dict[str, int] = {}
            return pd.Series([not block.value.overlaps(word_hashes(t, known), least_words, similarity) for t in texts], dtype=bool)

        return clean

    for block, alone in _blocks(benchmark, item_col, item_text, block_hashes):
        clean = docs.filter(clean_of(block)(F.col(text_col)))
        docs = clean if alone else settle(clean, "uncontaminated")
    return docs
