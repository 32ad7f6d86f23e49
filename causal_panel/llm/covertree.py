"""Hard negatives by inner product, searched in cover trees.

Vectors of integers are given one more coordinate, the root of M^2 - |x|^2 with M the largest norm of their block, so all have norm M and a larger
inner product with a query is a smaller distance. Over a block of distinct augmented vectors stands a cover tree: the centers of a level are
more than its radius apart, cover all vectors within it, and stay centers below; a level's radius is half that above. Every node knows the
largest distance to what lies under it. With s the inner product of query and center and e the norm of the query times that distance, all
scores under a node lie in s - e .. s + e. A descent takes the node of the highest bound first, leaves out nodes that lie outside the window of
scores, and stops when no bound reaches the last of the k best; scores of leaves are exact integers.

Spark deals candidates into blocks of about `BLOCK` rows of one label each (small labels share blocks) and anchors into portions of about `ANCHORS`;
a task searches one block for one portion, and the best of all blocks are ranked. Windows are first searched in a sixteenth of the blocks: what these
hold is the least that the others must reach to be handed on.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BLOCK, ANCHORS, FIRST_OF = 4096, 2048, 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Sums of squares from here on might not fit a long.
LARGEST_SQUARE = 2.0**62


class CoverTree:
    """A cover tree over `vectors` (integers, distinct rows), each with a non-empty list of (id, label) rows."""

    def __init__(self, vectors: np.ndarray, first_row: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """Rows first_row[k] .. first_row[k + 1] - 1 of `ids` and `labels` have vector k."""
        self.first_row, self.ids, self.labels = first_row, ids, labels
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        top = squares.max(initial=0.0)
        self.exact = np.float64 if top < 2.0**52 else np.int64
        self.points = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(0, top - squares))])
        self.slack = 1e-6 * (1 + np.sqrt(top))
        self._grow(vectors.astype(self.exact))

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.points[a], self.points[b]
        return np.sqrt(np.maximum(0, (x**2).sum(axis=-1)[:, None] + (y**2).sum(axis=-1) - 2 * x @ y.T))

    def _grow(self, vectors: np.ndarray) -> None:
        m = len(vectors)
        own, near = np.zeros(m, np.int64), self._distances(np.arange(m), np.zeros(1, np.int64))[:, 0]
        radius, centers, levels = near.max(initial=0.0), np.zeros(1, np.int64), []
        while len(centers) < m:
            levels.append((centers, own.copy()))
            radius /= 2
            far = np.flatnonzero(near > radius)
            for part in np.array_split(far, -(-len(far) // 512)) if len(far) else ():  # what another center covers needs no new one
                d = self._distances(part, centers)
                best = d.argmin(axis=1)
                own[part], near[part] = centers[best], d[np.arange(len(part)), best]
            far, new = far[near[far] > radius], []
            while len(far):
                new.append(far[0])
                d = self._distances(far, far[:1])[:, 0]
                d[0] = 0
                covered = d <= radius
                own[far[covered]], near[far[covered]] = far[0], d[covered]
                far = far[~covered]
            centers = np.append(centers, new).astype(np.int64)
            if radius < self.slack:  # as good as equal once augmented: leaves of their own
                centers = np.arange(m)
        levels.append((centers, np.arange(m)))
        ancestor, radii = np.arange(m), []
        for centers, own in reversed(levels):
            ancestor = own[ancestor]
            apart = self.points - self.points[ancestor]
            found = np.zeros(m)
            np.maximum.at(found, ancestor, np.sqrt((apart**2).sum(axis=1)))
            radii.append(np.where(np.bincount(ancestor, minlength=m) > 1, found + self.slack, 0.0))
        radii.reverse()
        # children stand together, level by level; a node with nothing but itself under it is a leaf and has none
        alive, self.root_radius, self.levels = np.zeros(1, np.int64), radii[0][0], []
        for depth in range(len(levels) - 1):
            below = levels[depth + 1][0]
            parent = levels[depth][1][below]
            place = np.full(m, -1)
            place[alive] = np.arange(len(alive))
            use = place[parent] >= 0
            below, parent = below[use], place[parent[use]]
            order = np.argsort(parent, kind="stable")
            below = below[order]
            r = radii[depth + 1][below]
            inner = np.flatnonzero(r > 0)
            number = np.full(len(below), -1)
            number[inner] = np.arange(len(inner))
            self.levels.append((np.searchsorted(parent[order], np.arange(len(alive) + 1)), below, r, number, vectors[below]))
            alive = below[inner]
        self.root_vector = vectors[0]

    def search(self, query: np.ndarray, windows: list[tuple[int, int, int]], allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each window (least score, largest score, k): ids and scores of the k first rows that `allowed(ids, labels)` lets in, by score and id."""
        query = query.astype(self.exact)
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        seen: dict[tuple[int, int], tuple] = {}

        def children(depth: int, k: int) -> tuple:
            """Leaf rows (ids, scores) and inner nodes (number, lowest, highest score) under a node; each is looked at once per query."""
            if depth < 0:  # above the root
                score, e = self.root_vector @ query, length * self.root_radius
                leaf, inner = np.zeros(0 if self.levels else 1, np.int64), np.zeros(1 if self.levels else 0, np.int64)
                return *self._rows(leaf, np.full(len(leaf), score), allowed), inner, inner + score - e, inner + score + e
            if (depth, k) not in seen:
                first, points, radius, number, vectors = self.levels[depth]
                part = slice(first[k], first[k + 1])
                score, e, number = vectors[part] @ query, length * radius[part], number[part]
                inner, leaf = number >= 0, number < 0
                ids, scores = self._rows(points[part][leaf], score[leaf], allowed)
                seen[depth, k] = ids, scores, number[inner], score[inner] - e[inner], score[inner] + e[inner]
            return seen[depth, k]

        for least, largest, k in windows:
            ids, scores, last, queue = np.zeros(0, np.int64), np.zeros(0, self.exact), least, [(-np.inf, -1, 0)]
            while queue and -queue[0][0] >= last:
                _, depth, node = heapq.heappop(queue)
                more_ids, more, number, low, high = children(depth, node)
                use = (more >= last) & (more <= largest)
                if use.any():
                    ids, scores = np.append(ids, more_ids[use]), np.append(scores, more[use])
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                    last = max(last, scores[-1]) if len(scores) == k else last
                for j in np.flatnonzero((high >= last) & (low <= largest)).tolist():
                    heapq.heappush(queue, (-high[j], depth + 1, int(number[j])))
            yield ids, scores

    def _rows(self, points: np.ndarray, score: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.first_row[points], self.first_row[points + 1] - self.first_row[points]
        row = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        use = allowed(self.ids[row], self.labels[row])
        return self.ids[row][use], np.repeat(score, n)[use]


def tree_of(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> CoverTree:
    """The tree of the distinct rows of `vectors`, with the rows that have them."""
    distinct, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    return CoverTree(distinct, np.append(0, np.cumsum(np.bincount(which.ravel()))), ids[order], labels[order])


def _matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v): distinct rows that take part, components as whole 256ths."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * 256))
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # Spark orders NaN above infinity
    small = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(c.cast("double") * 256, 2)) < LARGEST_SQUARE
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).filter(fine).filter(small)
    return kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v")).distinct()


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """`rows` with `block`, numbers from 0 on."""
    sizes = rows.groupBy("label").agg(F.count("*").alias("rows"))
    small = sizes.filter(F.col("rows") < block // 2).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    part = F.when(F.col("rows") < block // 2, F.struct(F.lit(None).cast("long").alias("label"), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-small // block)))).alias("salt"))).otherwise(
        F.struct(F.col("label"), F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("rows") / block)).alias("salt")))
    placed = settle(rows.join(sizes, "label").withColumn("part", part).drop("rows"), "vector-parts")
    numbers = placed.select("part").distinct().withColumn("block", F.row_number().over(Window.orderBy("part")) - 1)  # a row per block
    return settle(placed.join(numbers, "part").select("block", "id", "label", "v"), "vector-blocks")


def _search(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """(anchor, window, id, score): the k best rows of each block for each window of `anchors` (anchor, id, label, v, block, portion, windows)."""

    def work(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            width = max(map(len, [*asked["v"], *held["_v"]]))
            labels = held["_label"].to_numpy()
            tree = tree_of(held["_id"].to_numpy(), labels, _matrix(held["_v"], width))
            only = labels[0] if (labels == labels[0]).all() else None
            for anchor, own, label, query, windows in zip(asked["anchor"], asked["id"], asked["label"], _matrix(asked["v"], width), asked["windows"], strict=True):
                if not same and only is not None and only == label:
                    continue
                allowed = (lambda i, l, own=own, label=label: (l == label) & (i != own)) if same else (lambda i, l, label=label: l != label)
                asks = [(w["least"], w["largest"], w["k"]) for w in windows]
                for w, (ids, scores) in zip(windows, tree.search(query, asks, allowed), strict=True):
                    out.append(pd.DataFrame({"anchor": anchor, "window": w["window"], "id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "window": [], "id": [], "score": []})

    # a block for each portion that asks it; names of its own, as both sides come from one table
    copied = blocks.join(anchors.select("block", "portion").distinct(), "block").select(*[F.col(c).alias(f"_{c}") for c in ("block", "portion", "id", "label", "v")])
    return anchors.groupBy("block", "portion").cogroup(copied.groupBy("_block", "_portion")).applyInPandas(work, "anchor long, window long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, portion: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (rows for which `is_anchor`, over `id_col`, holds) and each of its first `positives` other rows of the same label: the first
    `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score. `label` replaces the label, over
    the columns of `rows`. Rows with a null id, label, vector or component, with one that is not finite, or with squares that sum up to
    2^62 or more take no part; a shorter vector is as one with zeros at its end. Equal rows count once; rows that share an id but differ
    are rows of their own, none of them another row for an anchor with that id. Other columns play no part. Without anchors, positives or
    negatives the result is empty.
    """
    used = settle(usable(rows, id_col, label_col, vector_col, F.col(label_col) if label is None else label), "vectors")
    blocks = _blocks(used, block)
    asking = used.withColumnRenamed("id", id_col).filter(is_anchor).withColumnRenamed(id_col, "id")
    asking = settle(asking.withColumn("anchor", F.xxhash64("id", "label", "v")), "anchors")
    n_portions, n_blocks = max(1, -(-asking.count() // portion)), blocks.agg(F.max("block")).first()[0]
    window = "array<struct<window:long,least:long,largest:long,k:int>>"
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if n_blocks is None:
        return rows.sparkSession.createDataFrame([], result)
    asking = asking.withColumn("portion", F.pmod(F.col("anchor"), F.lit(n_portions)))
    homes = blocks.select("label", "block").distinct()
    whole = F.array(F.struct(F.lit(0).alias("window"), F.lit(-int(LARGEST_SQUARE)).alias("least"), F.lit(int(LARGEST_SQUARE)).alias("largest"), F.lit(positives).alias("k"))).cast(window)
    near = _best(_search(asking.join(homes, "label").withColumn("windows", whole), blocks, same=True), positives)
    near = settle(near.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")

    hundredth = F.col("positive_score").cast("decimal(20,0)") / 100
    span = F.struct(F.col("positive_score").alias("window"), F.ceil(hundredth * low).cast("long").alias("least"), F.floor(hundredth * high).cast("long").alias("largest"), F.lit(negatives).alias("k"))
    spans = near.groupBy("anchor").agg(F.collect_set(span).cast(window).alias("windows"))  # at most `positives` each
    asked = settle(asking.join(spans, "anchor"), "windows")
    every = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks))))
    first = F.pmod(F.xxhash64("block"), F.lit(FIRST_OF)) == 0
    some = settle(_best(_search(every.filter(first), blocks.filter(first), same=False), negatives).drop("rank"), "first-negatives")
    reached = some.groupBy("anchor", "window").agg(F.count("*").alias("found"), F.min("score").alias("least")).filter(F.col("found") == negatives)
    floors = reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("floors"))
    raised = every.filter(~first).join(floors, "anchor", "left").withColumn("windows", F.transform("windows", lambda w: F.struct(
        w["window"].alias("window"), F.greatest(w["least"], F.element_at("floors", w["window"])).alias("least"), w["largest"].alias("largest"), w["k"].alias("k"))).cast(window))
    rest = _search(raised.drop("floors"), blocks.filter(~first), same=False)
    best = _best(some.unionByName(rest), negatives)
    pairs = near.join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor").join(best, (near["anchor"] == best["anchor"]) & (near["positive_score"] == best["window"]))
    return pairs.select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
