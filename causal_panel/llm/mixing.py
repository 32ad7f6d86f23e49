"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copy rate of each of its documents. The whole part is taken as it is. The fractions are
rounded in pairs: of two documents one gives words to the other, at random but so that neither's expectation changes, until one
of the two is a whole copy or none. The other goes on to the next pair, so the words of the pair stay what they were. Pairs are
formed inside buckets of about `BUCKET` documents, which Spark rounds side by side; what each bucket leaves over, one document, is
rounded in buckets of the next level, and so on to one document of each source, which is taken in part. So the words of a source meet
its target to within one word.

Which documents meet and the random numbers depend on ids and texts only: reruns and recomputed tasks agree.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_words, settle, share

#: Documents that a bucket rounds, and buckets whose residuals meet in one of the next level.
BUCKET, FANOUT = 4096, 64


def targets(sizes: DataFrame, weight: Column, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    `weight` is an expression over `source`, `source_size` and `place` (0, 1, ... by code point, null last). The targets share
    `total_share` of all words by weight; none is above `most` times its source, and what is cut is shared again: every
    target is the least of its ceiling and weight times one level. That level is the
    highest that is left for the others when the sources of the lowest ceilings over weights, any number of them, take theirs. The windows run over the table of sources, not over documents.
    """
    by_height = Window.orderBy("height", "place")
    whole = Window.partitionBy()
    weighed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", weight.cast("double"))
    return (
        weighed.withColumn("ceiling", F.col("source_size") * F.lit(most))
        .withColumn("height", F.col("ceiling") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(total_share) - (F.sum("ceiling").over(by_height) - F.col("ceiling")))
        .withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.sum("weight").over(by_height) + F.col("weight")))
        .withColumn("level", F.max("level").over(whole))
        .select("source", "source_size", "weight", F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))).alias("target"))
    )


def round_pairs(part: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Fractions after rounding in pairs, and the index of the one that is left (-1 if none). Words (part x size) keep their sum."""
    part, left = part.astype(float), -1
    for k in range(len(part)):
        if part[k] <= 0.0 or part[k] >= 1.0:
            continue
        if left < 0:
            left = k
            continue
        up = min((1 - part[left]) * size[left], part[k] * size[k])  # words that `left` may gain
        down = min(part[left] * size[left], (1 - part[k]) * size[k])  # and lose
        gain = up if draw[k] * (up + down) < down else -down
        part[left], part[k] = part[left] + gain / size[left], part[k] - gain / size[k]
        for i in (left, k):
            part[i] = 0.0 if part[i] < 1e-12 else 1.0 if part[i] > 1 - 1e-12 else part[i]
        left = left if 0.0 < part[left] < 1.0 else k if 0.0 < part[k] < 1.0 else -1
    return part, left


def _round_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", "size", "row"], kind="stable").reset_index(drop=True)
    part, left = round_pairs(rows["part"].to_numpy(), rows["size"].to_numpy(), rows["draw"].to_numpy())
    return rows.assign(part=part, open=np.arange(len(rows)) == left)


def rounded(rows: DataFrame, seed: int = 5) -> DataFrame:
    """`rows` (row, source, size, part in [0, 1)) with `part` rounded to 0 or 1, but for one row of each source."""
    buckets = max(1, -(-rows.count() // BUCKET))
    now = rows.withColumn("draw", share(F.col("row"), seed)).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "row"), F.lit(buckets)))
    done = []
    while True:
        out = settle(now.groupBy("source", "bucket").applyInPandas(_round_bucket, T.StructType([*now.schema.fields, T.StructField("open", T.BooleanType())])), "rounded")
        if buckets == 1:
            done.append(out)
            break
        done.append(out.filter("not open"))
        buckets = -(-buckets // FANOUT)
        now = out.filter("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FANOUT)).withColumn("draw", share(F.col("row"), seed + buckets))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def mix(docs: DataFrame, weight: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(`id_col`, size, source, source_size, target, taken): one row per row of `docs`; taken is the words that the mix takes, repeats counted.

    Null and blank texts have size 0 and take nothing. A null source is a source of its own. Equal rows are documents of
    their own. `weight` is as in `targets`. Other columns of `docs` play no part. An empty table gives an empty result.
    """
    sized = settle(docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")), "sizes")
    goals = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weight, total_share, most), "targets")
    joined = sized.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = settle(joined.withColumn("whole", F.floor(rate)).withColumn("part", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0)), "rates")
    taken = F.least(F.col("whole") * F.col("size") + F.round(F.col("part") * F.col("size")), F.floor(F.col("size") * F.lit(most))).cast("long")
    return rounded(rated).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "size", "source", "source_size", "target", taken.alias("taken"))
