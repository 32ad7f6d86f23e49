"""Ordering, limits, unions and set comparisons."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_k


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of the whole frame: each task keeps n, then n of those."""
    return df.orderBy(*order).limit(n)


def perspectives(matches: DataFrame, shared: Sequence[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """One row per match and side: the same columns seen from home and from away."""
    def seen(names, at_home):
        return matches.select(*shared, *[F.col(c).alias(n) for n, c in names.items()], F.lit(at_home).alias("is_home"))

    return seen(home, True).unionByName(seen(away, False))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key by order."""
    return top_k(df, keys, order, 1, "_r").drop("_r")


def set_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys with where they occur: both, left only or right only."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    where = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return l.join(r, list(keys), "full").select(*keys, where.alias("found"))
