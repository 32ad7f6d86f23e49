"""Order statistics that stay parallel when one group holds most of the rows.

A plain window over a group sorts the whole group in one task. Here a group is
first collapsed to its distinct values (partial aggregation). A group that is still
large is cut by magnitude, evenly between its own least and greatest value: that
splits long tails as well as values close together, though not a group of which
most values crowd in one spot and a few lie far off. A slice is a function of
the value and of exact counts and bounds, never of a sample, so a recomputed task
sees the same slices. Running totals are taken inside slices and shifted by the
totals of earlier slices.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

# Distinct values a slice should hold.
ROWS_PER_SLICE = 250_000


def magnitude(value: Column) -> Column:
    """A non-decreasing number that grows by one with each power of two, and evenly between them."""
    v = value.cast("double")
    octave = F.floor(F.log2(F.abs(v)))
    size = octave + F.abs(v) / F.pow(F.lit(2.0), octave) + 1100.0  # the offset keeps tiny magnitudes positive
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))


def even_cut(at: Column, low: Column, high: Column, cuts: Column) -> Column:
    """Which of `cuts` equal stretches of low..high holds `at`."""
    part = F.floor((at - low) / F.when(high > low, high - low) * cuts)
    return F.coalesce(F.least(F.greatest(part, F.lit(0)), cuts - 1), F.lit(0)).cast("bigint")


def sliced(counts: DataFrame, scope: Sequence[str], value: str, rows_per_slice: int) -> DataFrame:
    """Adds `_slice` to rows of distinct values: in the order of the value, and 0 in groups of up to `rows_per_slice`."""
    at = magnitude(F.col(value))
    # a row per `rows_per_slice` distinct values at most: some MB for 10^11 of them
    large = (
        counts.groupBy(*scope).agg(F.count(F.lit(1)).alias("_size"), F.min(at).alias("_low"), F.max(at).alias("_high"))
        .where(F.col("_size") > rows_per_slice).withColumn("_cuts", F.ceil(F.col("_size") / rows_per_slice)).drop("_size")
    )
    cut = even_cut(at, F.col("_low"), F.col("_high"), F.col("_cuts"))
    return counts.join(F.broadcast(large), scope, "left").withColumn("_slice", cut).drop("_low", "_high", "_cuts")


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per (keys, value) with totals at, before and in all of the group.

    `sums` maps a name to an aggregate column (default: a row count `n`). For each
    name the result has `name`, `name_before` (values strictly smaller) and
    `name_total`. Null values are left out. `value` must be numeric, keys not null.
    """
    sums = sums or {"n": F.count(F.lit(1))}
    keys = list(keys)
    scope = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*scope, value)
        .agg(*[agg.alias(name) for name, agg in sums.items()])
    )
    rows = sliced(counts, scope, value, rows_per_slice)
    cut = [*scope, "_slice"]
    totals = rows.groupBy(*cut).agg(*[F.sum(name).alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*scope)
    offsets = totals.select(
        *cut,
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums],
        *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_total") for name in sums],
    )
    inside = Window.partitionBy(*cut).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, cut).select(
        *keys,
        value,
        *[F.col(name) for name in sums],
        *[
            (F.coalesce(F.sum(name).over(inside), F.lit(0)) + F.col(f"_o_{name}")).alias(f"{name}_before")
            for name in sums
        ],
        *[F.col(f"{name}_total") for name in sums],
    )


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _name, _value) rows, one per column."""
    pairs = [F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p._name", "_p._value")


def percentile_ranks(
    df: DataFrame,
    keys: Sequence[str],
    outs: dict[str, str],
    fill: float | None = 0.5,
    min_values: int = 2,
    ids: Sequence[str] = (),
) -> DataFrame:
    """For each column: average-tie rank over the number of non-null values in the group.

    `outs` maps a column to the name of its rank. Null values get `fill`; so does every
    row of a group with fewer than `min_values` values. `fill=None` keeps nulls. All
    columns are ranked in one pass; keys must not be null. Where (keys, ids) names a row,
    the ranks come back in one narrow join instead of one wide join per column.
    """
    prefix = ordered_prefix(_long(df, keys, list(outs)), [*keys, "_name"], "_value")
    rank = (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("n_total")
    if fill is not None:
        rank = F.when(F.col("n_total") >= min_values, rank).otherwise(F.lit(fill))
    ranked = prefix.select(*keys, "_name", "_value", rank.alias("_rank"))
    out = df
    if ids:
        row = [*keys, *ids]
        placed = _long(df, row, list(outs)).join(ranked, [*keys, "_name", "_value"])
        wide = placed.groupBy(*row).agg(*[F.max(F.when(F.col("_name") == c, F.col("_rank"))).alias(n) for c, n in outs.items()])
        out = df.join(wide, row, "left")
    else:
        for column, name in outs.items():
            part = ranked.where(F.col("_name") == column).select(
                *keys, F.col("_value").alias("_match"), F.col("_rank").alias(name)
            )
            out = (
                out.withColumn("_match", F.col(column).cast("double"))
                .join(part, [*keys, "_match"], "left")
                .drop("_match")
            )
    if fill is not None:
        for name in outs.values():
            out = out.withColumn(name, F.coalesce(name, F.lit(fill)))
    return out


def percentile_rank(df, keys, value, out, fill: float | None = 0.5, min_values: int = 2) -> DataFrame:
    return percentile_ranks(df, keys, {value: out}, fill, min_values)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, without one task per group.

    `wanted` maps an output name to (column, quantile).
    """
    columns = sorted({c for c, _ in wanted.values()})
    prefix = ordered_prefix(_long(df, keys, columns), [*keys, "_name"], "_value")
    aggs = []
    for name, (column, q) in wanted.items():
        mine = F.col("_name") == column
        at = (F.col("n_total") - 1) * F.lit(float(q))
        for tag, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = mine & (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("_value"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(F.when(mine, at - F.floor(at))).alias(f"_s_{name}"))
    grouped = prefix.groupBy(*keys).agg(*aggs)
    outs = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_s_{n}")).alias(n)
        for n in wanted
    ]
    return grouped.select(*keys, *outs)


def ordinal_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, descending: bool = False
) -> DataFrame:
    """1-based position by (value, tie) and the group size `out_of`.

    (keys, tie) must be unique and numeric; ties in value go to the smaller `tie`.
    """
    work = df.select(*keys, (-F.col(value) if descending else F.col(value)).alias("_v"), F.col(tie).alias("_t"))
    outer = ordered_prefix(work, keys, "_v").select(
        *keys, "_v", F.col("n_before").alias("_above"), F.col("n_total").alias(f"{out}_of")
    )
    inner = ordered_prefix(work, [*keys, "_v"], "_t").select(*keys, "_v", "_t", F.col("n_before").alias("_tied"))
    placed = inner.join(outer, [*keys, "_v"]).select(
        *keys, F.col("_t").alias(tie), (F.col("_above") + F.col("_tied") + 1).alias(out), f"{out}_of"
    )
    return df.join(placed, [*keys, tie], "left")


def _earlier(rows: pd.DataFrame, target, low, high) -> np.ndarray:
    """How often each row counts for one ask."""
    use = rows["_epoch"].to_numpy() < target
    if "_side" in rows:
        side = rows["_side"].to_numpy()
        use = use & (side > low) & (side <= high)
    return np.where(use, rows["_n"].to_numpy(), 0)


def expanding_quantiles(
    df: DataFrame, keys: Sequence[str], epoch: str, value: str, asks: DataFrame, out: str, side: str | None = None, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """`asks` with `out`: the exact linear-interpolated quantile `q` of the rows of its group and of all epochs before its own.

    `asks` has `keys`, `epoch` and `q`; with `side`, also `low` and `high`: then only rows with low < side <= high count (a null side is below
    all). Null values are left out, and an ask without a row before it gets null. Rows are counted once per (group, epoch, value) and
    dealt into slices of the value. Every slice tells how many rows an ask has in it, the running total over slices says in which the wanted
    places lie, and that slice alone reads them off: no row is copied for a later epoch, and asks are as many as (slices x epochs).
    """
    scope = list(keys) or ["_all"]
    if not keys:
        df, asks = df.withColumn("_all", F.lit(0)), asks.withColumn("_all", F.lit(0))
    bounds = ["low", "high"] if side else []
    beside = [F.coalesce(F.col(side).cast("double"), F.lit(float("-inf"))).alias("_side")] if side else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*scope, F.col(epoch).alias("_epoch"), F.col(value).cast("double").alias("_value"), *beside).agg(F.count(F.lit(1)).alias("_n"))
    rows = settle(sliced(counts, scope, "_value", rows_per_slice), "value-slices")
    asked = asks.select(*scope, F.col(epoch).alias("_target"), "q", *bounds).distinct().withColumn("_ask", F.xxhash64("_target", "q", *bounds))
    names = [F.col(c).alias(f"_k_{c}") for c in scope]
    apart = rows.select(*names, F.col("_slice").alias("_k_slice"), "_epoch", "_value", "_n", *(["_side"] if side else []))
    schema = rows.select(*scope, "_slice").schema
    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by, by_rows = [*scope, "_slice"], [*[f"_k_{c}" for c in scope], "_k_slice"]

    def each(work, extra):
        """Runs `work(rows, ask)` for every ask of a slice."""

        def run(key: tuple, wanted: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("_value", kind="stable") if len(own) else own
            found, memory = [], {}
            for ask in wanted.to_dict("records") if len(own) else ():
                name = ask["_target"], ask.get("low"), ask.get("high")
                if name not in memory:
                    memory = {name: np.cumsum(_earlier(own, *name))}  # asks come sorted by it
                found.append((*key, ask["_ask"], *work(own, ask, memory[name])))
            return pd.DataFrame(found, columns=[*by, "_ask", *[e.split()[0] for e in extra.split(", ")]])

        return lambda wanted: wanted.groupBy(*by).cogroup(apart.groupBy(*by_rows)).applyInPandas(
            lambda key, a, b: run(key, a.sort_values(["_target", *bounds], kind="stable"), b), f"{wide}, _ask long, {extra}")

    slices = rows.select(*by).distinct()
    counted = each(lambda own, ask, total: (int(total[-1]),), "_in long")(asked.join(slices, scope))
    counted = settle(counted.where(F.col("_in") > 0), "ask-counts")
    line = Window.partitionBy(*scope, "_ask").orderBy("_slice")
    placed = counted.withColumn("_before", F.sum("_in").over(line) - F.col("_in")).withColumn("_total", F.sum("_in").over(Window.partitionBy(*scope, "_ask")))
    at = F.col("q") * (F.col("_total") - 1)
    placed = placed.join(asked.select(*scope, "_ask", "_target", "q", *bounds), [*scope, "_ask"]).withColumn("_at", at)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("_end"), F.floor("_at").alias("_place")), F.struct(F.lit(1).alias("_end"), F.ceil("_at").alias("_place"))))
    ends = placed.select("*", ends.alias("_e")).select("*", "_e._end", "_e._place").where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_in")))
    ends = ends.select(*by, "_ask", "_target", *bounds, "_end", "_at", (F.col("_place") - F.col("_before")).alias("_offset"))

    def read(own, ask, total):
        return int(ask["_end"]), float(ask["_at"]), float(own["_value"].to_numpy()[np.searchsorted(total, ask["_offset"], "right")])

    found = each(read, "_end int, _at double, _value double")(ends)
    low_end, high_end = (F.max(F.when(F.col("_end") == k, F.col("_value"))) for k in (0, 1))
    part = F.max("_at") - F.floor(F.max("_at"))
    settled = found.groupBy(*scope, "_ask").agg((low_end + (high_end - low_end) * part).alias(out))
    named = asks.withColumn("_ask", F.xxhash64(epoch, "q", *bounds)).join(settled, [*scope, "_ask"], "left").drop("_ask")
    return named if keys else named.drop("_all")
