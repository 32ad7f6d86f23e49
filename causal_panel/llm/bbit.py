"""Near copies by b-bit MinHash: documents whose sets of word shingles have a Jaccard similarity of at least 80 / 100, in groups.

Of each of `BANDS` x `ROWS` least hashes only the low `BITS` bits are retained, packed into bit planes. Bands of the whole least hashes name
candidates: two sets of similarity s share a band with a chance of 1 - (1 - s^ROWS)^BANDS, so a pair at 0.8 is missed three times in a
million. Inside a band's bucket two signatures are compared by counting the bits that agree: a share m of agreeing minima, of which chance
alone gives C = 2^-BITS, estimates the similarity as (m - C) / (1 - C). Pairs estimated at `SLACK` or more standard deviations under the
limit are dropped; what is left is walked breadth first, so a bucket hands on a spanning forest, never its pairs.

The trees of these forests are proposals. The sets of a proposal meet in one task, where links are confirmed by exact counts of shared
shingles. A proposal of over `largest` shingles is cut: its sets are first compared with a few pivots of it, and whatever is not one with the largest
class then meets slices of the rest in tasks of bounded size. Buckets of over `LARGEST_BUCKET` sets are proposals as they are.

Sets and shingles are told apart by 64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, whole_groups
from .simhash import connect

SHINGLE, PERCENT = 2, 80
BANDS, ROWS, BITS, SLACK = 32, 5, 2, 4.5
LARGEST_BUCKET, LARGEST_PROPOSAL, PIVOTS = 50_000, 1 << 23, 4
#: Shingles whose hashes are looked at together, and words whose hashes a task keeps.
STRETCH, KNOWN_WORDS = 1 << 13, 1 << 19
_K = BANDS * ROWS
_WIDE = -(-_K // 64) * 64
_DRAWN = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (2, _K, 1), np.uint64)
_TIMES, _PLUS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_KEYS = (np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2)) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hash of a word, computed when it is first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: Words, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words, or of the whole of a shorter text. Only A-Z is lower-cased, ASCII space splits."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    run = min(words, len(split))
    value = np.full(len(split) - run + 1, run, np.uint64)
    for k in range(run):
        value = _mixed(value * _MIX[0] + hashed[k : len(split) - run + 1 + k])
    return np.unique(value)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of the `BANDS` x `ROWS` 32-bit hashes of a set that is not empty."""
    least = np.full(_K, np.iinfo(np.uint32).max, np.uint64)
    for k in range(0, len(hashes), STRETCH):
        least = np.minimum(least, ((hashes[None, k : k + STRETCH] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed 64-bit number per band, of its whole minima."""
    keys = ((least.reshape(BANDS, ROWS) + np.uint64(1)) * _KEYS).sum(axis=1, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * _MIX[0]).view(np.int64)


def packed(least: np.ndarray, bits: int = BITS) -> bytes:
    """The low bits of each minimum: one plane of `_WIDE` bits per bit."""
    planes = np.zeros((bits, _WIDE), np.uint8)
    planes[:, :_K] = (least[None] >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(planes, axis=1).tobytes()


def unpacked(signatures: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of 64-bit words."""
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint64).reshape(len(signatures), -1)


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity by the share of minima whose retained bits agree, less what agrees by chance."""
    apart = (a ^ b).reshape(-1, bits, _WIDE // 64)
    share = 1 - np.bitwise_count(np.bitwise_or.reduce(apart, axis=1)).sum(axis=1) / _K
    chance = 2.0**-bits
    return (share - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT, bits: int = BITS, slack: float = SLACK) -> float:
    """Below this an estimate speaks against a similarity of `percent`: `slack` standard deviations under it, were no minimum to agree by chance."""
    s, chance = percent / 100, 2.0**-bits
    return (s - slack * np.sqrt(s * (1 - s) / _K) - chance) / (1 - chance)


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, then those of at[1], and so on."""
    return np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Walk:
    """Breadth-first walk over signatures: each visit looks only at what has not been reached, so a dense group costs about its size."""

    def __init__(self, signatures: np.ndarray, limit: float, links=None):
        self.signatures, self.limit, self.links = signatures, limit, links or (lambda k, near: near)

    def forest(self) -> np.ndarray:
        """Root of each row."""
        m = len(self.signatures)
        root, rest = np.arange(m), np.arange(m)
        while len(rest):
            first, rest, queue = rest[0], rest[1:], [rest[0]]
            while queue and len(rest):
                k = queue.pop()
                near = rest[estimate(self.signatures[k], self.signatures[rest]) >= self.limit]
                near = self.links(k, near) if len(near) else near
                if len(near):
                    root[near] = first
                    rest = np.setdiff1d(rest, near, assume_unique=True)
                    queue += near.tolist()
        return root


class _Sets:
    """Exact comparison of sets of hashes."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.fromiter(map(len, sets), np.int64, len(sets))
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.mark = np.zeros(len(values), bool)

    def similar(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that are at least `percent` similar to set k."""
        own = self.code[self.start[k] : self.start[k] + self.size[k]]
        self.mark[own] = True
        n = self.size[others]
        shared = np.add.reduceat(self.mark[self.code[_ranges(self.start[others], n)]], np.cumsum(n) - n, dtype=np.int64)
        self.mark[own] = False
        return others[100 * shared >= self.percent * (self.size[k] + n - shared)]


def exact_groups(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Root index of each of the sets (none empty) by links of `percent` or more, transitive."""
    exact = _Sets(sets, percent)
    signatures = np.frombuffer(b"".join(packed(minima(s)) for s in sets), np.uint64).reshape(len(sets), -1)
    return _Walk(signatures, least_estimate(percent), exact.similar).forest()


def _propose(percent: int):
    limit = least_estimate(percent)

    def work(rows: pa.Table) -> pa.Table:
        band, node, signatures = rows["band"].to_numpy(), rows["node"].to_numpy(), unpacked(rows["signature"])
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(first, len(band)))
        lead = np.repeat(first, size)
        near = estimate(signatures[lead], signatures) >= limit
        root = np.where(near, lead, np.arange(len(band)))
        apart = np.add.reduceat(~near, first)
        for at, n in zip(first[apart > 0].tolist(), size[apart > 0].tolist(), strict=True):  # all but a few are near their first
            if n > 2:
                root[at : at + n] = at + _Walk(signatures[at : at + n], limit).forest()
        hung = root != np.arange(len(band))
        return pa.table({"a": node[hung], "b": node[root[hung]]})

    return work


def _confirm(percent: int):
    def work(rows: pa.Table) -> pa.Table:
        known, group, node = Words(), rows["root"].to_numpy(), rows["node"].to_numpy()
        sets = [shingles(t, known) for t in rows["text"].to_pylist()]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        a, b = [], []
        for at, n in zip(first.tolist(), np.diff(np.append(first, len(group))).tolist(), strict=True):
            root = exact_groups(sets[at : at + n], percent)
            hung = np.flatnonzero(root != np.arange(n))
            a.append(node[at + hung])
            b.append(node[at + root[hung]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return work


def _cut_proposals(sets: DataFrame, largest: int, percent: int) -> DataFrame:
    """(a, b): links that connect what is connected in the proposals `sets` (root, node, n, text), in tasks of about `largest` shingles.

    Each set meets `PIVOTS` sets of its proposal; then all sets outside its largest class so far meet all others, columns of theirs with
    slices of the whole.
    """
    order = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))
    pivots = sets.withColumn("_place", order).filter(F.col("_place") <= PIVOTS).select("root", F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        known, memory = Words(), {}
        out = []
        for x, y in zip(left, right, strict=True):
            if y not in memory:
                memory = memory if len(memory) < 64 else {}
                memory[y] = shingles(y, known)
            s, t = shingles(x, known), memory[y]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * shared >= percent * (len(s) + len(t) - shared))
        return pd.Series(out)

    stars = settle(sets.join(pivots, "root").filter("node != pivot").filter(linked(F.col("text"), F.col("pivot_text"))).select(
        F.col("node").alias("a"), F.col("pivot").alias("b")), "pivot-links")
    classes = connect(stars).toDF("_node", "class")
    held = settle(sets.join(classes, sets["node"] == classes["_node"], "left").drop("_node").withColumn("class", F.coalesce("class", "node")), "proposal-classes")
    sizes = held.groupBy("root", "class").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    top = sizes.groupBy("root").agg(F.max(F.struct("members", "class")).getField("class").alias("top"), F.sum("shingles").alias("all"),
                                    F.count("*").alias("classes"))
    shape = top.filter("classes > 1").join(sizes, "root").groupBy("root", "top", "all").agg(
        F.sum(F.when(F.col("class") != F.col("top"), F.col("shingles")).otherwise(0)).alias("outside"))
    shape = shape.select("root", "top", F.ceil(F.col("all") / largest).alias("slices"), F.ceil(F.col("outside") / largest).alias("columns"))
    placed = held.join(shape, "root").withColumn("slice", F.pmod(F.xxhash64("node"), "slices")).withColumn("column", F.pmod(F.xxhash64("node"), "columns"))
    across = placed.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).withColumn("inside", F.lit(False))
    down = placed.filter("class != top").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).withColumn("inside", F.lit(True))
    tiles = across.unionByName(down).select(F.xxhash64("root", "slice", "column").alias("tile"), "root", "node", "class", "inside", "text")

    def work(rows: pa.Table) -> pa.Table:
        known, a, b = Words(), [], []
        tile, node, label, inside = (rows[c].to_numpy(zero_copy_only=False) for c in ("tile", "node", "class", "inside"))
        sets_ = [shingles(t, known) for t in rows["text"].to_pylist()]
        for key in np.unique(tile):
            own = np.flatnonzero(tile == key)
            exact = _Sets([sets_[k] for k in own], percent)
            signatures = np.frombuffer(b"".join(packed(minima(sets_[k])) for k in own), np.uint64).reshape(len(own), -1)
            classes, limit = label[own].copy(), least_estimate(percent)
            for k in np.flatnonzero(inside[own]).tolist():
                other = np.flatnonzero(~inside[own] & (classes != classes[k]))
                other = other[estimate(signatures[k], signatures[other]) >= limit] if len(other) else other
                for j in (exact.similar(k, other).tolist() if len(other) else []):
                    if classes[j] != classes[k]:
                        a.append(node[own[k]])
                        b.append(node[own[j]])
                        classes[classes == classes[j]] = classes[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stars.unionByName(whole_groups(tiles, "tile", work, "a long, b long", rows=1))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, largest: int = LARGEST_PROPOSAL) -> DataFrame:
    """(`id_col`, n_shingles, component_id): one row per row of `docs`; component_id is the smallest id reachable, the row's own included.

    Null, empty and blank texts have the empty set and link with nothing, not even each other. Rows with equal ids are kept, each with its own
    set. A null id takes its group's smallest other id (null if there is none). Other columns of `docs` play no part. An empty table gives
    an empty result.
    """

    @F.pandas_udf("node long, n long, signature binary, bands array<long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        known, rows = Words(), []
        for text in texts:
            found = shingles(text, known)
            if len(found):
                least = minima(found)
                rows.append((xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), len(found), packed(least), band_keys(least)))
            else:
                rows.append((None, 0, None, None))
        out = pd.DataFrame(rows, columns=["node", "n", "signature", "bands"])
        return out.astype({"node": "Int64"})

    name = F.xxhash64(F.col(text_col))
    marked = docs.select(F.col(id_col).alias("id"), name.alias("name"), marks(F.col(text_col)).alias("mark"))
    marked = settle(marked.select("id", "name", "mark.*"), "bbit-marks")
    nodes = settle(marked.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.min("name").alias("name"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "bbit-sets")
    ends = nodes.select("node", F.explode("bands").alias("band"))
    met = settle(ends.groupBy("band").agg(F.count("*").alias("sets"), F.min("node").alias("lead")).filter("sets > 1"), "bbit-buckets")
    # both sides are tables, so that Spark can split a bucket that is too large to be looked into
    members = settle(ends.join(met, "band"), "bbit-members")
    looked = members.filter(F.col("sets") <= LARGEST_BUCKET).join(nodes.select("node", "signature"), "node").select("band", "node", "signature")
    near = whole_groups(looked, "band", _propose(percent), "a long, b long")
    crowded = members.filter((F.col("sets") > LARGEST_BUCKET) & (F.col("node") != F.col("lead"))).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    proposed = settle(connect(near.unionByName(crowded)), "bbit-proposals")
    sized = proposed.join(nodes.select("node", "n", F.col("name").alias("_name")), "node")
    large = settle(sized.groupBy("root").agg(F.sum("n").alias("shingles")).filter(F.col("shingles") > largest).select("root"), "bbit-large")
    texts = docs.select(name.alias("name"), F.col(text_col).alias("text"))
    held = settle(texts.join(sized, F.col("name") == F.col("_name")).select("root", "node", "n", "text").dropDuplicates(["node"]), "bbit-texts")
    links = whole_groups(held.join(large, "root", "left_anti").select("root", "node", "text"), "root", _confirm(percent), "a long, b long", rows=4096)
    if large.take(1):
        links = links.unionByName(_cut_proposals(held.join(large, "root", "left_semi"), largest, percent))
    roots = connect(links).withColumnRenamed("node", "_node")
    joined = nodes.select("node", "least").join(roots, F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    joined = settle(joined.select("node", "least", "root"), "bbit-roots")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "root").select("node", "component_id")
    out = marked.select("id", "n", "node").join(classes, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
