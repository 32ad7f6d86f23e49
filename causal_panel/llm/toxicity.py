"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts that a label confirms as toxic; unlabelled examples are a sample of all documents, drawn by a hash of the id, no label of
which is read. The class prior p is the share of toxic ones among the labelled rows that may be learned from, counted over all of them. The risk of a
classifier is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second part estimates the risk on clean texts and can't fall
below zero in truth, so where an estimate does, the step goes back up. Numpy classifiers (logistic loss, one weight per word, soft-thresholded)
are fitted one after another in Spark tasks, each on the sample less one fold, and scored as their mean.

The sample is bounded by `max_positives` confirmed texts and about `max_unlabelled` others, the model by `max_words` weights; scoring reads every
whole text.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, share

#: Words are runs of letters, lower-cased.
LETTERS = re.compile(r"[^\W\d_]+")
#: Confirmed and unlabelled texts that are read for a fit, classifiers that share them, and words that a model may hold.
MAX_POSITIVES, MAX_UNLABELLED, MEMBERS, MAX_WORDS = 8_000, 16_000, 3, 50_000
#: (text, word) places that a step looks at together.
STRETCH = 1 << 19


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def fit(starts: np.ndarray, codes: np.ndarray, positive: np.ndarray, prior: float, unlabelled: np.ndarray | None = None, rounds: int = 400, rate: float = 0.5, select: float = 0.6, shrink: float = 2e-5, min_rows: int = 4, max_words: int = MAX_WORDS) -> dict[int, float]:
    """Weights by word code, and the intercept under none, of one non-negative PU classifier.

    Text k has the distinct codes codes[starts[k]:starts[k + 1]]; it may be confirmed, unlabelled (all are, if left out) or both. A first descent finds the words that tell; a
    second one with the soft threshold `shrink` fits the weights of those alone. The threshold of the first is `select` x prior / sqrt(confirmed
    texts): so many standard errors of a slope, less of them for words that few texts hold, whatever the size of the sample.
    """
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    named = pa.array(codes, pa.int64()).dictionary_encode()  # hashed: sorting takes five times the memory
    known, col = named.dictionary.to_numpy(), named.indices.to_numpy()
    seen = _count(col, len(known))
    often = np.flatnonzero(seen >= min_rows)
    telling = often[np.lexsort((known[often], -seen[often]))[:max_words]]
    weights: dict[int | None, float] = {}
    for sparse in (select * prior / math.sqrt(max(1, int(positive.sum()))), shrink):
        place = np.full(len(known), -1, np.int32)
        place[telling] = np.arange(len(telling), dtype=np.int32)
        at = place[col]
        use = at >= 0
        weight, bias = _descend(row[use], at[use], len(telling), positive, prior, rounds, rate, sparse, unlabelled)
        weights = {None: float(bias)} | {int(known[t]): float(w) for t, w in zip(telling, weight, strict=True) if w}
        telling = telling[weight != 0]
    return weights


def _stretches(n: int) -> Iterator[slice]:
    return (slice(k, k + STRETCH) for k in range(0, n, STRETCH))


def _count(at: np.ndarray, n: int, value: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """How often each of 0..n-1 is in `at`, or the sums of value[of] there; temporary arrays are as long as a stretch only."""
    total = np.zeros(n, np.int64 if value is None else np.float64)
    for s in _stretches(len(at)):
        total += np.bincount(at[s], None if value is None else value[of[s]], n)
    return total


def _slope(z: np.ndarray, positive: np.ndarray, drawn: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """The step's direction in each text's log-odds z, and whether it follows the whole risk or goes back up because the clean part is below zero."""
    n_positive, n_drawn = int(positive.sum()), max(1, int(drawn.sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    clean_slope = np.where(drawn, p / n_drawn, 0.0) - np.where(positive, prior * p / n_positive, 0.0)  # of R-(unlabelled) - prior R-(positives)
    whole = np.logaddexp(0, z[drawn]).sum() / n_drawn >= prior * np.logaddexp(0, z[positive]).mean()
    return (clean_slope + np.where(positive, prior * (p - 1) / n_positive, 0.0) if whole else -clean_slope), bool(whole)


def _descend(row: np.ndarray, col: np.ndarray, width: int, positive: np.ndarray, prior: float, rounds: int, rate: float, sparse: float, unlabelled: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept after `rounds` steps down the non-negative risk, each weight with its own step size and soft threshold."""
    n = len(positive)
    drawn = np.ones(n, bool) if unlabelled is None else unlabelled
    weight, bias, seen_w, seen_b = np.zeros(width), math.log(prior / (1 - prior)), np.zeros(width), 0.0
    for _ in range(rounds):
        slope, _ = _slope(bias + _count(row, n, weight, col), positive, drawn, prior)
        by_word, by_bias = _count(col, width, slope, row), slope.sum()
        seen_w, seen_b = seen_w + by_word**2, seen_b + by_bias**2
        step = rate / (np.sqrt(seen_w) + 1e-8)
        weight = weight - step * by_word
        weight = np.sign(weight) * np.maximum(0, np.abs(weight) - step * sparse)
        bias -= rate * by_bias / (math.sqrt(seen_b) + 1e-8)
    return weight, bias


def learnable(id_col: Column) -> Column:
    """Whether labels of this id may be learned: crc32 of the id as text is not a multiple of 5. Null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, members: int = MEMBERS) -> list[dict[str, float]]:
    """The members' weights, learned from labels of `learnable` ids and from unlabelled texts. `prior` is the share of toxic texts; left out,
    that among all labelled ids, held in 0.0001 to 0.5.

    Ids labelled more than once count as toxic if any label says so; null labels are no confirmation. A member without a positive
    is left out; without any, the list is empty and scores are 0. Rows that share an id are drawn together.
    """
    known = labels.filter(learnable(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.coalesce(F.max(label_col), F.lit(0)).alias("_toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.count_if(F.col("_toxic") == 1)).first()
    if not n_toxic:
        return []
    share_toxic = prior if prior is not None else min(0.5, max(1e-4, n_toxic / n_known))
    confirmed = known.filter((F.col("_toxic") == 1) & (share("_id", 2) < 1.2 * max_positives / n_toxic)).orderBy(F.xxhash64("_id"), "_id").limit(max_positives)
    tokens = F.pandas_udf(lambda s: s.map(lambda t: sorted(words_of(t))), "array<string>")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    drawn = share("_doc", 3) < max_unlabelled / max(1, docs.count())
    sample = texts.join(F.broadcast(confirmed), F.col("_doc") == F.col("_id"), "left").select("_doc", "_text", F.col("_id").isNotNull().alias("positive"), drawn.alias("drawn"))
    sample = sample.filter("positive or drawn").select(  # the confirmed ids are max_positives small rows at most
        F.pmod(F.xxhash64(F.lit(1), "_doc"), F.lit(members)).alias("fold"), "positive", "drawn", tokens(F.col("_text")).alias("words"))
    sample = settle(sample, "sampled-words")
    coded = sample.select("fold", "positive", "drawn", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
    fits = []
    for m in range(members):  # a task each, which holds numbers only, and a job each, so that no executor holds two
        shares = coded.filter(F.col("fold") != m) if members > 1 else coded

        def member(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in rows if b.num_rows]
            positive, drawn = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0, bool) for c in ("positive", "drawn"))
            if positive.any():
                codes = np.concatenate([b["codes"].flatten().to_numpy() for b in batches])
                lengths = np.concatenate([np.diff(b["codes"].offsets.to_numpy()) for b in batches])
                batches.clear()
                model = fit(np.append(0, np.cumsum(lengths)), codes, positive, share_toxic, drawn)
                yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.int64()), pa.array(list(model.values()), pa.float64())], names=["code", "weight"])

        fits.append(settle(shares.repartition(1).mapInArrow(member, "code long, weight double").withColumn("member", F.lit(m)), "weights"))
    weights = fits[0]
    for more in fits[1:]:
        weights = weights.unionByName(more)
    words = sample.select(F.explode("words").alias("word")).distinct().withColumn("code", F.xxhash64("word"))
    named = weights.join(words, "code", "left").select("member", F.coalesce("word", F.lit("")).alias("word"), "weight")
    models: dict[int, dict[str, float]] = {}
    for m, word, weight in named.collect():  # members x max_words rows at most
        models.setdefault(m, {})[word] = weight
    return [models[m] for m in sorted(models)]


def scorer(models: list[dict[str, float]]):
    """A column function from text to the mean log-odds of the members, squeezed to 0..1; with no members always 0."""
    merged: dict[str, float] = {}
    for model in models:
        for word, weight in model.items():
            merged[word] = merged.get(word, 0.0) + weight / len(models)
    bias = merged.pop("", None)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if bias is None:
            return pd.Series(np.zeros(len(texts)))
        sums = [bias + sum(sorted(merged[w] for w in words_of(t) & merged.keys())) for t in texts]
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -500, 500))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, held_out, score, predicted): one row per row of `docs`; predicted is 1 from a score of 0.5 on.

    Null, empty and blank texts get the score of a text without known words. Repeated rows are scored each; other columns play no part.
    """
    score = scorer(train(docs, labels, id_col, text_col))
    return docs.select(F.col(id_col), ~learnable(F.col(id_col)), score(F.col(text_col))).toDF(id_col, "held_out", "score").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def clean_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its columns, less those that the classifier rejects. No shuffle: the score is a filter on the scan."""
    return docs.filter(scorer(train(docs, labels, id_col, text_col))(F.col(text_col)) < 0.5)
