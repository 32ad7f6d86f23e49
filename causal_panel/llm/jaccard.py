"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8, in groups.

Fingerprints and MinHash bands propose, exact sets decide. Texts of one shingle set are one node. The SimHash of its shingles is linked to
others of 4 or fewer differing bits by op3's self-join over binary tries; pairs at 0.8 differ in some ten bits, where no trie can tell them from
strangers. So bands add the rest: two nodes of similarity s share one of `BANDS` bands of `ROWS` least hashes with a chance of
1 - (1 - s^ROWS)^BANDS: a pair at 0.8 is missed three times in a million, a closer one less often. Nodes that reach each other by either come to one task, which compares the sets themselves, so no pair below the similarity is linked. There a
leader's similarities to all sets are counted at once from an inverted index; the members of two leaders' groups are only compared
while the groups are apart and the triangle inequality of 1 - similarity lets them meet. Pairs never leave a task.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .simhash import connect, links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Shingles whose hashes are looked at together.
STRETCH = 1 << 13
_DRAWN = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES, _PLUS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words (all of a shorter text). As in op3, only A-Z is lower-cased and ASCII space splits."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(split[k : k + words])) for k in range(max(1, len(split) - words + 1))], np.uint64))


def bands_of(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit number for each band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), STRETCH):
        least = np.minimum(least, (hashes[None, k : k + STRETCH] * _TIMES + _PLUS).min(axis=1))
    digests = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def fingerprint_of(hashes: np.ndarray) -> int | None:
    """The SimHash of a shingle set as a signed 64-bit number: a bit is 1 if set in over half the hashes. None for the empty set."""
    if not len(hashes):
        return None
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STRETCH):
        counts += np.unpackbits(hashes[k : k + STRETCH].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)[0])


def by_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all `nodes` (node, fp) whose fingerprints reach each other by 4 or fewer differing bits."""
    held = nodes.filter(F.col("fp").isNotNull()).select("node", "fp")
    leads = settle(held.groupBy("fp").agg(F.min("node").alias("lead")), "set-fingerprints")
    equal = held.join(leads, "fp").filter("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    found = links(leads.select("fp")).toDF("fa", "fb")
    one, other = leads.toDF("fa", "a"), leads.toDF("fb", "b")
    return equal.unionByName(found.join(one, "fa").join(other, "fb").select("a", "b"))


def by_bands(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all `nodes` (node, bands) that reach each other by common bands."""
    ends = nodes.select("node", F.explode("bands").alias("band"))
    met = ends.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead != last").select("band", "lead")
    return ends.join(met, "band").filter("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def groups(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[int]:
    """Root index of each of the distinct sets (not empty), linked at `similarity` or more; transitive."""
    m, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)[np.argsort(code, kind="stable")]
    ends = np.cumsum(np.bincount(code))
    begins, places = ends - np.bincount(code), np.split(code, np.cumsum(sizes)[:-1])
    root = list(range(m))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def similar(k: int) -> np.ndarray:
        """Similarity of set k to all; links what reaches the limit."""
        at, n = begins[places[k]], (ends - begins)[places[k]]
        shared = np.bincount(owner[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        found = shared / (sizes[k] + sizes - shared)
        for j in np.flatnonzero(found >= similarity - 1e-12).tolist():
            a, b = find(k), find(j)
            root[max(a, b)] = min(a, b)
        return found

    leader, members, near = np.full(m, -1), defaultdict(list), []
    for k in range(m):
        if leader[k] < 0:
            found = similar(k)
            own = np.flatnonzero((found >= similarity - 1e-12) & (leader < 0))
            near += [(k, x) for x in members if found[x] >= 1 - 3 * (1 - similarity) - 1e-9]
            leader[own], members[k] = k, [x for x in own.tolist() if x != k]
    done: set[int] = set()
    for a, b in near:
        for k in min(members[a], members[b], key=len):
            if find(a) == find(b):
                break
            if k not in done:
                done.add(k)
                similar(k)
    return [find(k) for k in range(m)]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, component_id): the group of every row of `docs`, named by the smallest id in it.

    Null, empty and blank texts are one group. A null id takes its group's smallest other id (null if there is none). An empty table
    gives an empty result.
    """

    @F.pandas_udf("node long, bands array<long>, fp long")
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "bands": [bands_of(s) for s in sets], "fp": pd.array([fingerprint_of(s) for s in sets], "Int64")})

    name = F.xxhash64(F.col(text_col))
    marked = docs.select(F.col(id_col).alias("id"), name.alias("name"), marks(F.col(text_col)).alias("mark"))
    marked = settle(marked.select("id", "name", "mark.node", "mark.bands", "mark.fp"), "shingle-bands")
    nodes = settle(marked.groupBy("node").agg(F.min("id").alias("least"), F.min("name").alias("name"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "shingle-sets")
    together = connect(by_fingerprints(nodes).unionByName(by_bands(nodes)))
    wanted = nodes.select("node", F.col("name").alias("_name")).join(together.select("node", F.col("root").alias("bucket")), "node")
    texts = docs.select(name.alias("name"), F.col(text_col).alias("text"))
    held = settle(texts.join(wanted, F.col("name") == F.col("_name")).select("bucket", "node", "text").dropDuplicates(["node"]), "proposed-texts")

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node, "root": node[groups([shingles(t) for t in rows["text"]])]})

    roots = held.groupBy("bucket").applyInPandas(decide, "node long, root long")
    joined = settle(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "shingle-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.select("node", "root").join(least, "root").select("node", "component_id")
    return marked.join(classes, "node", "left").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its columns, less all but one document of each group of near copies: the one with the smallest id stays.

    Of rows that repeat an id that stays, one stays. Rows without an id can't be told apart and all stay.
    """
    kept = near_copies(docs, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    return named.join(kept, named[id_col] == kept["_kept"], "left_semi").dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
