"""Removal of repeated byte strings by a column-wise sorted construction over many short strings.

Every string of `WIDTH` bytes is sent to its anchor: the 40-byte string inside it whose hash is least, the leftmost if tied. Equal strings
have equal anchors at equal places, so only strings that line up at an anchor are ever compared. The neighbouring strings of one anchor are
kept as one block of bytes. Blocks that occur twice as a whole need no further work; where the blocks of an anchor differ, they are a
small collection of strings, lined up at the anchor, and the suffix order of that collection is built column by column from the right:
each round inserts one symbol of every string, which sorts the strings stably by that symbol (the symbols in this order are the column's
Burrows-Wheeler transform) and carries the common prefixes of neighbours over. A string whose common prefix with a neighbour reaches
`WIDTH` occurs elsewhere. Columns are read in sequence from blocks that Spark has sorted by anchor and that its shuffle files hold; a task holds one
batch of anchors at a time.

An anchor of more than `LARGEST_GROUP` different blocks is settled window by window instead: its strings are counted by two hashes.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

WIDTH, ANCHOR = 200, 40
#: Places of the anchor in a string.
PLACES = WIDTH - ANCHOR + 1
#: Different blocks of one anchor that a task may hold, about 0.7 kB each.
LARGEST_GROUP = 20_000
#: Blocks of whole anchors that are compared in one call; only a single anchor may have more.
TOGETHER = 4096
#: String starts that are looked at together.
STRETCH = 1 << 20
_MASK = np.uint64(STRETCH * 2 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


@cache
def _symbols(seed: int) -> np.ndarray:
    """A 64-bit number for each byte."""
    return _mixed(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, as many as `size`."""
    base = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)[seed]
    return tuple(np.cumprod(np.array([1] + [b] * size, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))


class Hashes:
    """Hashes of any substring of a text by prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        up, self.down = _powers(seed, max(1 << 16, 1 << int(len(data)).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_symbols(seed)[data] * up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(values)
    rows = np.pad(values, (0, -n % width), constant_values=np.iinfo(np.uint64).max).reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forward[width - 1 : n])


def blocks_of(text: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first string's start, anchor's place in it, further strings) of each block of a text."""
    data = np.frombuffer(text, np.uint8)
    n = len(data) - WIDTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    first, second = Hashes(data, 0), Hashes(data, 1)
    found = []
    for k in range(0, n, STRETCH):
        starts = np.arange(k, min(n, k + STRETCH) + PLACES - 1)
        ranked = _mixed(first.of(starts, starts + ANCHOR)) & ~_MASK | (starts - k).astype(np.uint64)
        at = k + (_least(ranked, PLACES) & _MASK).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((k + new, at[new], np.append(new[1:], len(at)) - new - 1))
    start, at, more = (np.concatenate(x) for x in zip(*found, strict=True))
    return first.of(at, at + ANCHOR), second.of(start, start + more + WIDTH), start, at - start, more


def columns(group: np.ndarray, texts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of each `WIDTH`-byte string that another string of its group has at the same distance from the anchor.

    `place` is where the anchor starts in each string; `group` is sorted. One symbol of every string a round, from the right.
    """
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    symbols = np.zeros((WIDTH + PLACES, m), np.uint16)  # row: distance to the anchor; 0: no symbol
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    owner = np.repeat(np.arange(m), sizes)
    symbols[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + PLACES - 1 - place[owner], owner] = flat
    order, common, found = np.arange(m), np.zeros(m + 1, np.int32), []
    for row in range(len(symbols) - 1, -1, -1):
        symbol = symbols[row, order]
        if not symbol.any():
            continue
        key = group[order] * 257 + symbol
        turn = np.argsort(key, kind="stable")
        same = np.flatnonzero((key[turn[1:]] == key[turn[:-1]]) & (symbol[turn[1:]] > 0)) + 1
        merged = np.zeros(m + 1, np.int32)
        if len(same):
            spans = np.stack([turn[same - 1] + 1, turn[same] + 1], axis=1).ravel()
            merged[same] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[turn], merged
        if row < PLACES:
            twice = order[(common[:-1] >= WIDTH) | (common[1:] >= WIDTH)]
            if len(twice):
                found.append(np.stack([twice, row - PLACES + 1 + place[twice]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the runs of consecutive starts."""
    rank = np.lexsort((start, owner))
    owner, start = owner[rank], start[rank]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])) if len(owner) else np.zeros(0, np.int64)
    return owner[new], start[new], start[np.append(new[1:], len(owner)) - 1] if len(owner) else start


_BLOCKS = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("shape", pa.int32())])
_SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64())])


def _find_blocks(batches):
    for batch in batches:
        rows = [blocks_of(t.as_buffer().to_pybytes()) for t in batch["bytes"]]
        n = np.array([len(r[0]) for r in rows], np.int64)
        anchor, block, start, place, more = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in range(5))
        yield pa.RecordBatch.from_arrays([
            pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), pa.array(np.repeat(batch["k1"].to_numpy(), n)), pa.array(np.repeat(batch["k2"].to_numpy(), n)),
            pa.array(start), pa.array((place * 256 + more).astype(np.int32))], schema=_BLOCKS)


def _compare(batches):
    """Runs of repeated strings of the blocks that occur once. Blocks come sorted by anchor; an anchor may go on in the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held, batch])
        anchors = table["anchor"].to_numpy()
        cut = int(np.searchsorted(anchors == anchors[-1], True)) if len(anchors) else 0  # where the last anchor begins
        held = table.slice(cut).to_batches()
        for a, b in _portions(anchors[:cut]):
            yield _compare_batch(table.slice(a, b - a))
    if held:
        yield _compare_batch(pa.Table.from_batches(held))


def _portions(anchors: np.ndarray):
    """(first, end) of portions of sorted anchors: as many whole anchors as have at most `TOGETHER` rows, at least one."""
    ends, at = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors)), 0
    while at < len(anchors):
        k = int(np.searchsorted(ends, at + TOGETHER, "right")) - 1
        end = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[k + 1])
        yield at, end
        at = end


def _compare_batch(table: pa.Table) -> pa.RecordBatch:
    shape, n = table["shape"].to_numpy(), table["n"].to_numpy()
    _, group = np.unique(table["anchor"].to_numpy(), return_inverse=True)
    rank = np.argsort(group, kind="stable")
    texts = table["text"].to_pylist()
    owner, start = columns(group[rank], [texts[k] for k in rank], (shape >> 8)[rank].astype(np.int64))
    owner = rank[owner]
    own = (n[owner] == 1) & (start >= 0) & (start <= (shape & 255)[owner])
    owner, first, last = _runs(owner[own], start[own])
    at = table["at"].to_numpy()[owner]
    return pa.RecordBatch.from_arrays([pa.array(table[k].to_numpy()[owner]) for k in ("k1", "k2")] + [pa.array(at + first), pa.array(at + last)], schema=_SPANS)


def _spread(batches):
    """Two hashes of every string of every block."""
    for batch in batches:
        for k, text in enumerate(batch["text"].to_pylist()):
            data = np.frombuffer(text, np.uint8)
            start = np.arange(len(data) - WIDTH + 1)
            hashed = [Hashes(data, seed).of(start, start + WIDTH).view(np.int64) for seed in (0, 1)]
            same = [np.full(len(start), batch[c][k].as_py()) for c in ("n", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashed, *same, start + batch["at"][k].as_py())], schema=_WINDOWS)


def repeated_spans(docs: DataFrame, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """(k1, k2, first, last): starts first..last of strings that also start elsewhere, in the rows of `docs` (k1, k2, bytes).

    k1, k2 name a text; rows with the same name are equal and count as often as they stand.
    """
    ddl = "anchor long, block long, k1 long, k2 long, at long, shape int"
    found = docs.mapInArrow(_find_blocks, ddl)
    # as a table of its own, so that the join below shuffles both sides and Spark can split a frequent anchor
    again = settle(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    met = settle(found.join(again, "anchor", "left_semi"), "anchored")
    blocks = settle(met.groupBy("anchor", "shape", "block").agg(
        F.count("*").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("at").alias("at")), "blocks")
    whole = blocks.filter("n > 1").select("anchor", "shape", "block")
    of_whole = met.join(whole, ["anchor", "shape", "block"], "left_semi").select("k1", "k2", F.col("at").alias("first"), (F.col("at") + F.col("shape").bitwiseAND(255)).alias("last"))
    differing = blocks.groupBy("anchor").agg(F.count("*").alias("blocks")).filter("blocks > 1")
    wanted = blocks.join(differing, "anchor")
    length = F.col("shape").bitwiseAND(255) + WIDTH
    cut = settle(wanted.join(docs, ["k1", "k2"]).select(
        "anchor", "shape", "n", "k1", "k2", "at", "blocks", F.substring("bytes", F.col("at").cast("int") + 1, length).alias("text")), "block-texts")
    spans = "k1 long, k2 long, first long, last long"
    small = cut.filter(F.col("blocks") <= largest_group).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, spans)
    large = cut.filter(F.col("blocks") > largest_group).mapInArrow(_spread, "w1 long, w2 long, n long, k1 long, k2 long, first long")
    twice = large.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    singles = large.join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "first", F.col("first").alias("last"))
    return of_whole.unionByName(small).unionByName(singles)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest_group: int = LARGEST_GROUP) -> DataFrame:
    """(`id_col`, n_bytes, n_removed, n_spans, kept): one row per row of `docs`, kept the bytes that are left.

    Removed is each byte of a `WIDTH`-byte string that starts anywhere else too, in the input as it was. Null texts are empty;
    texts under `WIDTH` bytes stay whole. Equal rows are documents of their own, so they repeat each other; ids may be null.
    Other columns of `docs` play no part. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col(id_col), text).alias("k2"), text.cast("binary").alias("bytes"))
    spans = repeated_spans(named.drop("id"), largest_group)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def strip(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, runs in zip(texts, spans, strict=True):
            if runs is None or not len(runs):
                rows.append((0, 0, text))
                continue
            mark = np.zeros(len(text) + 1, np.int32)
            np.add.at(mark, [r["first"] for r in runs], 1)
            np.add.at(mark, [r["last"] + WIDTH for r in runs], -1)
            gone = np.cumsum(mark[:-1]) > 0
            rows.append((int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    out = named.join(by_text, ["k1", "k2"], "left").withColumn("_out", strip("bytes", "spans"))
    return out.select(F.col("id").alias(id_col), F.octet_length("bytes").cast("long").alias("n_bytes"), "_out.n_removed", "_out.n_spans", "_out.kept")
