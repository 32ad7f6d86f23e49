"""Isotonic fits of every (epoch, stratum) at once: pools of adjacent violators, merged in order through a tree.

Points of a stratum are dealt into slices of the forecast. A task pools the points of its slice for each later epoch; the pools of a slice are few,
and pooling pools gives what pooling all points would give, so runs of slices are merged, then runs of those, until one is left.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .scale import ROWS_PER_SLICE, sliced

#: Slices whose pools are merged in one task.
FAN = 64
_POOL = ["_low", "_high", "_s", "_w"]


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Adjacent violators pooled: rows (low, high, sum, weight) with rising means, from rows in the order of `low`."""
    out: list[list[float]] = []
    for row in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist(), strict=True):
        out.append(list(row))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, end, s, w = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = end, out[-1][2] + s, out[-1][3] + w
    return np.array(out).reshape(-1, 4)


def expanding_isotonic(df: DataFrame, stratum: str, forecast: str, target: str, observed: Column, out: str, least: int = 250, rows_per_slice: int = ROWS_PER_SLICE, fan: int = FAN) -> DataFrame:
    """`df` with `out`: the isotonic map of the forecast, fitted on the observed rows of all earlier epochs of the stratum.

    Targets below zero count as zero. Between pools the map is a line, beyond them it is flat. With fewer than `least` earlier rows, or without a
    stratum, the forecast stands; rows that are not observed are zero.
    """
    value, name = F.col(forecast).cast("double"), F.xxhash64(stratum)
    points = df.where(observed & F.col(stratum).isNotNull()).groupBy(name.alias("_stratum"), F.col("epoch").alias("_epoch"), value.alias("_value")).agg(
        F.sum(F.greatest(F.col(target).cast("double"), F.lit(0.0))).alias("_s"), F.count(F.lit(1)).cast("double").alias("_w"))
    points = settle(sliced(points.where(F.col("_value").isNotNull()), ["_stratum"], "_value", rows_per_slice), "isotonic-points")
    asked = df.where(F.col(stratum).isNotNull()).select(name.alias("_stratum"), F.col("epoch").alias("_target")).distinct()
    kind = dict(asked.dtypes)
    shape = f"_stratum {kind['_stratum']}, _target {kind['_target']}, _slice long, _low double, _high double, _s double, _w double"
    first = points.select(*[F.col(c).alias(f"_p{c}") for c in ("_stratum", "_slice", "_epoch", "_value", "_s", "_w")])

    def by_slice(key: tuple, targets: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.groupby(["_p_value", "_p_epoch"], sort=True)[["_p_s", "_p_w"]].sum().reset_index() if len(own) else own
        parts = []
        for t in sorted(targets["_target"].unique()) if len(own) else ():
            seen = own[own["_p_epoch"] < t].groupby("_p_value", sort=True)[["_p_s", "_p_w"]].sum()
            pools = pooled(seen.index.to_numpy(), seen.index.to_numpy(), seen["_p_s"].to_numpy(), seen["_p_w"].to_numpy())
            parts.append(pd.DataFrame(pools, columns=_POOL).assign(_stratum=key[0], _target=t, _slice=key[1]))
        names = ["_stratum", "_target", "_slice", *_POOL]
        return pd.concat(parts)[names] if parts else pd.DataFrame({n: [] for n in names})

    slices = points.select("_stratum", "_slice").distinct()
    pools = settle(asked.join(slices, "_stratum").groupBy("_stratum", "_slice").cogroup(first.groupBy("_p_stratum", "_p_slice")).applyInPandas(by_slice, shape), "isotonic-pools")

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_low", kind="stable")
        found = pooled(*(rows[c].to_numpy() for c in _POOL))
        return pd.DataFrame(found, columns=_POOL).assign(_stratum=key[0], _target=key[1], _slice=key[2])[["_stratum", "_target", "_slice", *_POOL]]

    left = points.agg(F.coalesce(F.max("_slice"), F.lit(0))).first()[0]
    while left > 0:
        left //= fan
        pools = settle(pools.withColumn("_slice", F.floor(F.col("_slice") / fan).cast("long")).groupBy("_stratum", "_target", "_slice").applyInPandas(merged, shape), "isotonic-pools")
    enough = pools.groupBy("_stratum", "_target").agg(F.sum("_w").alias("_rows")).where(F.col("_rows") >= least).drop("_rows")
    pools = pools.join(enough, ["_stratum", "_target"]).drop("_slice")

    placed = df.where(observed & F.col(stratum).isNotNull() & value.isNotNull()).select(name.alias("_stratum"), F.col("epoch").alias("_target"), value.alias("_f")).distinct()
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_f"), F.lit(8)))
    parts = pools.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).select(*[F.col(c).alias(f"_q{c}") for c in ("_stratum", "_target", "_part", *_POOL)])

    def read(key: tuple, asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(own):
            return pd.DataFrame({"_stratum": [], "_target": [], "_f": [], "_map": []})
        own = own.sort_values("_q_low", kind="stable")
        x = np.stack([own["_q_low"], own["_q_high"]], axis=1).ravel()
        y = np.repeat((own["_q_s"] / own["_q_w"]).to_numpy(), 2)
        return pd.DataFrame({"_stratum": key[0], "_target": key[1], "_f": asks["_f"], "_map": np.interp(asks["_f"].to_numpy(), x, y)})

    maps = placed.groupBy("_stratum", "_target", "_part").cogroup(parts.groupBy("_q_stratum", "_q_target", "_q_part")).applyInPandas(
        read, f"_stratum {kind['_stratum']}, _target {kind['_target']}, _f double, _map double")
    met = F.col(stratum).isNotNull() & (name == F.col("_stratum")) & (F.col("epoch") == F.col("_target")) & (value == F.col("_f"))
    kept = F.when(observed, F.coalesce("_map", value)).otherwise(F.lit(0.0))
    return df.join(maps, met, "left").select(*[c for c in df.columns if c != out], kept.alias(out))
