"""Collocations: phrases of 2 to 4 words, counted in counting quotient filters and scored by their weakest cut.

Words that occur often enough in a language get dense ids; a word below the threshold can't be part of a phrase at it and ends a run. The ids of an
n-gram are packed into one number of n x `bits` bits and permuted by a Feistel network, which can be undone. The top bits of the
permuted number name a shard, the next `q` its quotient, all others its remainder. A filter keeps remainders in slots sorted by number, a
bit per quotient that occurs and a bit per slot that ends a run, and a counter of a byte (a longer one where that overflows). Nothing is lost:
number and count come back exactly. A task sums what it reads into such filters and sends a filter per shard; the filters of a shard are
merged in order. Lengths are counted in turn, and an n-gram is only counted where both (n-1)-grams in it are frequent, if these fit
`MOST_KNOWN`; if they don't, all are counted, with the same result.

The words' ids travel to the tasks if the dictionary is within `MOST_WORDS` and `MOST_BYTES`; a larger one is joined to the words instead.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

LEAST, LONGEST, TOP = 30, 4, 2000
#: A longer phrase drops a part of it from this percentage of the part's count on.
COVERED = 80
#: Bounds of what is broadcast: words and their bytes, frequent n-grams of one length.
MOST_WORDS, MOST_BYTES, MOST_KNOWN = 1_000_000, 32 << 20, 4_000_000
#: Entries that a task holds before it sends its filters on, entries that a shard is meant to have, and the most shards (as a power of two).
HELD, SHARD, MOST_SHARDS = 1 << 20, 1 << 20, 16
_TOKEN = re.compile(rb"[^\x20\x09\x0A]+|\x0A")
_BREAKS = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROUNDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, with a line feed where a piece ends."""
    return _TOKEN.findall(text.translate(_BREAKS))


# --- numbers of n-grams and their permutation


def lanes(n: int, bits: int) -> tuple[int, int]:
    """Bits of the left and right half of an n-gram's number."""
    return n // 2 * bits, (n - n // 2) * bits


def pack(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right halves of the packed ids of `grams` (rows x n)."""
    half = grams.shape[1] // 2
    out = []
    for words in (grams[:, :half], grams[:, half:]):
        value = np.zeros(len(grams), np.uint64)
        for k in range(words.shape[1]):
            value = value << np.uint64(bits) | words[:, k].astype(np.uint64)
        out.append(value)
    return out[0], out[1]


def unpack(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    columns = [lane >> np.uint64(bits * k) & mask for lane, words in ((left, n // 2), (right, n - n // 2)) for k in range(words - 1, -1, -1)]
    return np.stack(columns, axis=1).astype(np.int64)


def _stir(x: np.ndarray, key: np.uint64, bits: int) -> np.ndarray:
    x = (x + key) * _ROUNDS[0]
    x = (x ^ (x >> np.uint64(32))) * _ROUNDS[1]
    return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)


def permute(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = lanes(n, bits)
    for k in (0, 2):
        left = left ^ _stir(right, _ROUNDS[k], a)
        right = right ^ _stir(left, _ROUNDS[k + 1], b)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = lanes(n, bits)
    for k in (2, 0):
        right = right ^ _stir(left, _ROUNDS[k + 1], b)
        left = left ^ _stir(right, _ROUNDS[k], a)
    return left, right


# --- counting quotient filters


def summed(left: np.ndarray, right: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers and their total counts."""
    if not len(left):
        return left, right, count
    order = np.lexsort((right, left))
    left, right, count = left[order], right[order], count[order]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    return left[first], right[first], np.add.reduceat(count, first)


def _plane(values: np.ndarray, slots: np.ndarray, n_slots: int, bits: int) -> bytes:
    out = np.zeros((n_slots, -(-bits // 8)), np.uint8)
    out[slots] = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : out.shape[1]]
    return out.tobytes()


def encode(left: np.ndarray, right: np.ndarray, count: np.ndarray, left_bits: int, right_bits: int) -> bytes:
    """A filter of sorted distinct numbers, of which `left` has `left_bits` bits."""
    m = len(left)
    q = min(left_bits, max(0, int(m - 1).bit_length()))
    quotient = (left >> np.uint64(left_bits - q)).astype(np.int64) if q else np.zeros(m, np.int64)
    rank = np.arange(m)
    slot = np.maximum.accumulate(quotient - rank) + rank  # linear probing: the quotient's own slot, or the next free one
    n_slots = max(1 << q, int(slot[-1]) + 1)
    occupied, run_end, counter = np.zeros(1 << q, bool), np.zeros(n_slots, bool), np.zeros(n_slots, np.uint8)
    occupied[quotient] = True
    run_end[slot[np.append(quotient[1:] != quotient[:-1], True)]] = True
    counter[slot] = np.minimum(count, 255)
    head = np.array([m, q, n_slots], np.int64).tobytes()
    rest = left & np.uint64((1 << (left_bits - q)) - 1)
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(), counter.tobytes(), _plane(rest, slot, n_slots, left_bits - q),
                     _plane(right, slot, n_slots, right_bits), count[count >= 255].astype("<i8").tobytes()])


def decode(data: bytes, left_bits: int, right_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted numbers and counts of a filter."""
    m, q, n_slots = np.frombuffer(data, np.int64, 3).tolist()
    at = 24

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return np.frombuffer(data, np.uint8, n, at - n)

    quotient = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q))
    end = np.flatnonzero(np.unpackbits(take(-(-n_slots // 8)), count=n_slots))
    start = np.maximum(np.append(0, end[:-1] + 1), quotient)
    length = end - start + 1
    slot = np.repeat(start - np.cumsum(length) + length, length) + np.arange(m)
    count = take(n_slots)[slot].astype(np.int64)

    def plane(bits: int) -> np.ndarray:
        width = -(-bits // 8)
        out = np.zeros((m, 8), np.uint8)
        out[:, :width] = take(n_slots * width).reshape(n_slots, width)[slot]
        return out.view("<u8")[:, 0].astype(np.uint64)

    left = np.repeat(quotient, length).astype(np.uint64) << np.uint64(left_bits - q) if q else np.zeros(m, np.uint64)
    left, right = left | plane(left_bits - q), plane(right_bits)
    count[count == 255] = np.frombuffer(data, "<i8", int((count == 255).sum()), at)
    return left, right, count


# --- words


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): all words of `docs` (lang, text), summed in each task first."""

    def run(batches):
        held: Counter = Counter()

        def sent():
            keys = [k for k in held if k[1] != b"\n"]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                                              pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                for word, f in Counter(tokens(text)).items():
                    held[lang, word] += f
                if len(held) > HELD // 2:
                    yield from sent()
        if held:
            yield from sent()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): words that occur `least` times or more, with ids from 1 on."""
    words = settle(counts.filter(F.col("f") >= least).withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(256))), "words")
    parts = words.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = words.join(F.broadcast(parts.select("part", "before")), "part")  # 256 rows
    rank = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return settle(numbered.select((rank + F.col("before")).alias("id"), "lang", "word", "f"), "dictionary")


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Ids with runs of zeros cut to one."""
    return ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))] if len(ids) else ids


def id_runs(docs: DataFrame, words: DataFrame, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(ids): a row per text, zero where a run of words ends."""
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if size[0] <= most_words and size[1] <= most_bytes:
        known: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", F.col("word").cast("binary").alias("word"), "id").toLocalIterator():
            known.setdefault(r.lang, {})[bytes(r.word)] = r.id
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            for batch in batches:
                rows = []
                for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                    own = shared.value.get(lang, {})
                    rows.append(_squeezed(np.array([own.get(w, 0) for w in tokens(text)], np.int32)))
                ends = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["ids"])

        return docs.mapInArrow(run, "ids array<int>")

    def spread(batches):
        for batch in batches:
            rows = [tokens(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            n = [len(r) for r in rows]
            places = np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["doc"].to_numpy(), n)), pa.array(places), batch["lang"].take(pa.array(np.repeat(np.arange(len(n)), n))),
                                              pa.array([w for r in rows for w in r], pa.binary()).cast(pa.string())], names=["doc", "place", "lang", "word"])

    numbered = settle(docs.withColumn("doc", F.monotonically_increasing_id()), "numbered-texts")
    each = settle(numbered.mapInArrow(spread, "doc long, place int, lang string, word string"), "words-in-place")
    found = each.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    return found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("id", F.lit(0)).cast("int").alias("id")))).alias("w")).select(F.col("w.id").alias("ids"))


# --- n-grams


def _frequent(ids: np.ndarray, known: list[np.ndarray | None]) -> list[np.ndarray]:
    """For each length from 1 on of which the frequent n-grams are known: at each place the number of the n-gram that begins there, 0 if it isn't frequent."""
    out = [ids.astype(np.int64)]
    for keys in known:
        if keys is None:
            break
        g = out[-1]
        pair = g[:-1] << 32 | g[1:]
        place = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        out.append(np.where((keys[place] == pair) & (g[:-1] > 0) & (g[1:] > 0), place + 1, 0) if len(keys) else np.zeros(len(pair), np.int64))
    return out


def gram_counts(runs: DataFrame, n: int, bits: int, known: list[np.ndarray | None], shards: int, least: int, held: int = HELD) -> DataFrame:
    """(ids, f): the n-grams of `runs` that occur `least` times or more. There are 2^`shards` shards; `known` has the frequent shorter n-grams."""
    left_bits, right_bits = lanes(n, bits)
    shard_bits = min(shards, left_bits)
    inner = left_bits - shard_bits
    shared = runs.sparkSession.sparkContext.broadcast(known)

    def fill(batches):
        parts, size = [], 0

        def sent():
            left, right, count = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            shard = (left >> np.uint64(inner)).astype(np.int64)
            left = left & np.uint64((1 << inner) - 1)
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + 1]), pa.array([encode(left[a:b], right[a:b], count[a:b], inner, right_bits)], pa.binary())], names=["shard", "filter"])

        for batch in batches:
            column = batch["ids"]
            values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[1:] - column.offsets[0].as_py()
            ids = np.insert(values, ends, 0)  # no n-gram reaches into the next text
            for a in range(0, len(ids), held):  # the next stretch begins where this one's last n-gram ends
                stretch = ids[a : a + held + n - 1]
                seen = _frequent(stretch, shared.value)[: n - 1]
                top = len(seen)
                m = max(0, len(stretch) - n + 1)
                use = np.ones(m, bool)
                for k in range(n - top + 1):
                    use &= seen[-1][k : k + m] > 0
                at = np.flatnonzero(use)
                grams = np.stack([stretch[at + k] for k in range(n)], axis=1)
                part = summed(*permute(*pack(grams, bits), n, bits), np.ones(len(at), np.int64))
                parts.append(part)
                size += len(part[0])
                if size > held:
                    yield from sent()
                    parts, size = [], 0
        if size:
            yield from sent()

    def merge(batches):
        at, parts, done, waiting = None, [], 0, 0

        def frequent():
            left, right, count = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            often = count >= least
            left, right = restore(left[often] | np.uint64(at << inner), right[often], n, bits)
            ids = unpack(left, right, n, bits)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(np.int32).ravel()), n).cast(pa.list_(pa.int32())), pa.array(count[often])], names=["ids", "f"])

        for batch in batches:
            for shard, data in zip(batch["shard"].to_pylist(), batch["filter"].to_pylist(), strict=True):
                if shard != at and parts:
                    yield from frequent()
                    parts, done, waiting = [], 0, 0
                at = shard
                parts.append(decode(data, inner, right_bits))
                waiting += len(parts[-1][0])
                if waiting > max(done, held):
                    parts = [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    done, waiting = len(parts[0][0]), 0
        if parts:
            yield from frequent()

    filters = runs.mapInArrow(fill, "shard long, filter binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "ids array<int>, f long")


def _numbers(grams: DataFrame, n: int, known: list[np.ndarray | None]) -> np.ndarray | None:
    """Sorted keys of the frequent n-grams, each of the numbers of its two parts; none if there are too many or the parts aren't known."""
    if (known and known[-1] is None) or grams.count() > MOST_KNOWN:
        return None
    rows = grams.select("ids").toArrow()["ids"].combine_chunks()  # at most MOST_KNOWN rows
    ids = rows.flatten().to_numpy().reshape(-1, n)
    ids = np.append(ids, np.zeros((len(ids), 1), ids.dtype), axis=1).ravel()
    g = _frequent(ids, known)[-1]
    at = np.arange(0, len(ids), n + 1)
    return np.sort(g[at] << 32 | g[at + 1])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_words: int = MOST_WORDS, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, then count, then the phrase's bytes.

    Null texts are empty, a null language is `und`. Repeated rows count as often as they stand; other columns play no part. Without a phrase at
    `least` occurrences the result is empty.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = settle(word_counts(texts), "word-counts")
    totals = settle(counts.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = dictionary(counts, least)
    n_words, total = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    bits, shards = max(4, n_words.bit_length()), min(MOST_SHARDS, max(0, (total // SHARD).bit_length()))
    runs = settle(id_runs(texts, words, most_words), "id-runs")
    known: list[np.ndarray | None] = []
    phrases = words.select(F.array(F.col("id").cast("int")).alias("ids"), "f")
    for n in range(2, longest + 1):
        found = settle(gram_counts(runs, n, bits, known, shards, least, held), f"grams-{n}")
        phrases = phrases.unionByName(found)
        if n < longest:
            known.append(_numbers(found, n, known))
    return _scored(spark, phrases, words, totals, top)


def _scored(spark: SparkSession, phrases: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    candidates = phrases.filter(F.size("ids") > 1)
    parts = candidates.filter(F.size("ids") > 2).select("f", F.size("ids").alias("n"), "ids").select("f", "n", "ids", F.explode(F.expr("sequence(2, n - 1)")).alias("len"))
    inside = parts.select("f", F.explode(F.expr("transform(sequence(1, n - len + 1), k -> slice(ids, k, len))")).alias("ids")).groupBy("ids").agg(F.max("f").alias("longer"))
    kept = candidates.join(inside, "ids", "left").filter(F.expr(f"longer is null or cast(100 as decimal(3)) * cast(longer as decimal(19)) < cast({COVERED} as decimal(3)) * cast(f as decimal(19))")).select("ids", F.col("f").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).withColumn("head", F.expr("slice(ids, 1, k)")).withColumn("tail", F.expr("slice(ids, k + 1, size(ids))"))
    cuts = cuts.join(phrases.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("(cast(2000000 as decimal(7)) * cast(a as decimal(19))) div (cast(l as decimal(19)) + cast(r as decimal(19)))")
    scored = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = scored.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "word"), "id").groupBy("ids").agg(
        F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "word"))).getField("word"), " ").alias("phrase"))
    named = scored.join(spelled, "ids").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = named.withColumn("rank", first.cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
