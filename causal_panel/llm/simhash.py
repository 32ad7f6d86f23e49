"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join over binary tries.

Two fingerprints link at `budget` or fewer differing bits. If they do, one of their halves differs in at most half the
budget, so two tries are walked, one that reads the left half first and one that reads the right half first, each with that
smaller budget for its first 32 levels and the whole budget for all 64. The top levels of a trie are walked by Spark: a
fingerprint is sent to every prefix within the budget (at most 1 + D + D(D-1)/2 prefixes of D bits for a budget of two, half of
them by order). From there a task walks pairs of nodes together, adds up their differing bits and drops a pair as soon as it is
over budget; a pair of leaves is settled at once by its remaining bits. Pairs of subtrees that are one component already are
dropped as well, so a dense group costs no more than its links need, and only a spanning forest leaves the task.
"""
from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Node pairs that a task expands at once.
CHUNK = 1 << 20
#: Fingerprints that a prefix holds on the average, and more than which the largest may not hold while prefixes can grow.
MEAN_NODE, LARGEST_NODE, DEEPEST = 2048, 200_000, 32


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned integer; no words: 0. Hashes are added up in blocks, so long texts take little memory."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z is lower-cased, only ASCII white space splits
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts, hashed = np.zeros(64, np.int64), partial(xxhash.xxh64_intdigest, seed=seed)
    lasts = ends[min(shingle, len(words)) - 1 :]
    for k in range(0, n, 1 << 16):
        block = [hashed(joined[a:b]) for a, b in zip(starts[k : min(n, k + (1 << 16))].tolist(), lasts[k : k + (1 << 16)].tolist(), strict=False)]
        counts += np.unpackbits(np.array(block, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, fp): one row per row of `docs`, fp the fingerprint's bits as a long. Null or empty text: 0. Other columns are left out."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), bits(F.col(text_col)).alias("fp"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each element, as its smallest index, after the links a-b."""
    while True:
        ra, rb = root[a], root[b]
        if not (apart := ra != rb).any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


class _Trie:
    """A binary trie over sorted distinct 64-bit numbers; node k of a level is the numbers lo[k]..hi[k]-1, which share that many top bits."""

    def __init__(self, values: np.ndarray, top: int):
        self.values, self.levels = values, {}
        n, self.top = len(values), top
        for depth in range(top, 65):
            first = np.ones(n, bool)
            first[1:] = (values[1:] >> np.uint64(64 - depth) if depth else np.zeros(n - 1)) != (values[:-1] >> np.uint64(64 - depth) if depth else np.zeros(n - 1))
            lo = np.flatnonzero(first).astype(np.int32)
            self.levels[depth] = lo, np.append(lo[1:], n).astype(np.int32), np.cumsum(first, dtype=np.int32) - 1
            if len(lo) == n:  # all are leaves
                break
        self.deepest = depth

    def children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 0 and 1 child of each node, -1 where there is none."""
        lo, hi, _ = self.levels[depth]
        below = self.levels[depth + 1][2]
        first, last = below[lo[nodes]], below[hi[nodes] - 1]
        bit = (self.values[lo[nodes]] >> np.uint64(63 - depth) & np.uint64(1)).astype(bool)
        return np.where(bit, -1, first), np.where(first == last, np.where(bit, first, -1), last)


def forest(values: np.ndarray, top: int, own: int, budget: int = 4, first_budget: int = 2, split: int = 32) -> np.ndarray:
    """Root index of each of the sorted distinct `values` by links of which at least one end has the prefix `own` of `top` bits."""
    trie, root = _Trie(values, top), np.arange(len(values), dtype=np.int32)
    lo, _, _ = trie.levels[top]
    prefixes = (values[lo] >> np.uint64(64 - top) if top else np.zeros(len(lo), np.uint64)).astype(np.int64)
    mine = np.flatnonzero(prefixes == own).astype(np.int32)
    if not len(mine):
        return root
    near = np.arange(len(lo), dtype=np.int32)
    stack = [(top, np.full(len(near), mine[0], np.int32), near, np.bitwise_count(prefixes ^ own).astype(np.int8))]
    while stack:
        depth, a, b, err = stack.pop()
        if len(a) > CHUNK:
            stack += [(depth, a[k : k + CHUNK], b[k : k + CHUNK], err[k : k + CHUNK]) for k in range(0, len(a), CHUNK)]
            continue
        lo, hi, _ = trie.levels[depth]
        joined = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        one = joined[lo] == joined[hi - 1]  # nodes that are one component
        use = ~(one[a] & one[b] & (root[lo[a]] == root[lo[b]])) & ((a != b) | (hi[a] - lo[a] > 1))
        a, b, err = a[use], b[use], err[use]
        leaf = (hi[a] - lo[a] == 1) & (hi[b] - lo[b] == 1)
        if leaf.any():
            i, j = lo[a[leaf]], lo[b[leaf]]
            linked = np.bitwise_count(values[i] ^ values[j]) <= budget
            root = _roots(root, i[linked], j[linked])
            a, b, err = a[~leaf], b[~leaf], err[~leaf]
        if not len(a):
            continue
        (a0, a1), (b0, b1), same = trie.children(depth, a), trie.children(depth, b), a == b
        limit, below = first_budget if depth < split else budget, []
        for x, y, extra, once in ((a0, b0, 0, True), (a1, b1, 0, True), (a0, b1, 1, True), (a1, b0, 1, ~same)):
            use = np.flatnonzero((x >= 0) & (y >= 0) & (err <= limit - extra) & once)
            below.append((x[use], y[use], err[use] + np.int8(extra)))
        a, b, err = (np.concatenate(x) for x in zip(*below, strict=True))
        if len(a):
            stack.append((depth + 1, a, b, err))
    return root


def links(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints `nodes` (fp), found by the walk of node pairs."""
    n = nodes.count()
    depth, first_budget = min(DEEPEST, max(0, math.ceil(math.log2(max(n, 1) / MEAN_NODE)))), budget // 2
    halves = nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "fp").select(
        "half", F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))).alias("turned"))

    def prefix(bits: int) -> Column:
        return F.shiftrightunsigned("turned", 64 - bits) if bits else F.lit(0).cast("long")

    while depth < DEEPEST and n > LARGEST_NODE:  # near copies crowd a few prefixes: longer ones until none is too large
        if (halves.groupBy("half", prefix(depth)).count().agg(F.max("count")).first()[0] or 0) <= LARGEST_NODE:
            break
        depth += 2
    masks = [0]
    for _ in range(first_budget):
        masks = sorted({m ^ (1 << k) for m in masks for k in range(depth)} | set(masks))
    sent = halves.withColumn("prefix", prefix(depth)).withColumn(
        "own", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("prefix")))))

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        half, own = key
        values = np.unique(rows["turned"].to_numpy(np.int64).view(np.uint64))
        root = forest(values, depth, int(own), budget, first_budget)
        hung = np.flatnonzero(root != np.arange(len(root)))
        pair = np.stack([values[hung], values[root[hung]]])
        if half:
            pair = pair << np.uint64(32) | pair >> np.uint64(32)
        return pd.DataFrame({"a": pair[0].view(np.int64), "b": pair[1].view(np.int64)})

    return sent.filter("own <= prefix").select("half", "own", "turned").groupBy("half", "own").applyInPandas(walk, "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, by alternating large and small stars.

    Each round is written to the shared folder, which also cuts the lineage. Rounds go with the logarithm of the longest chain.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    seen = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = ends.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ends.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small_least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(small_least, F.col("a") == F.col("u"))
        edges = settle(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").filter("a != b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """(`id_col`, fp, component_id): the class of every row of `docs`; component_id is the smallest id reachable, the row's own included.

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows with equal ids are kept, each with its own
    fingerprint. A null id takes its group's smallest other id (null if there is none). Other columns of `docs` play no part.
    An empty table gives an empty result.
    """
    marked = settle(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id"), "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connect(links(nodes.select("fp"), budget))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its columns, less all but one document of each group of near-duplicates: the one with the smallest id stays.

    Of rows that repeat an id that stays, one stays. Rows without an id can't be told apart and all stay.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    return named.join(kept, named[id_col] == kept["_kept"], "left_semi").dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
