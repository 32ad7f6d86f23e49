"""Expanding estimators from additive statistics: a deadline is scored before it is learnt from.

Rows are reduced to sums per (stratum, deadline) in one aggregation. Windows, folds and solves run
on that small table (strata x deadlines), and the result is joined back to the rows.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markets import geometric_blend, probability_blend
from ..functions.scalars import clip, col, first_match, interpolate_knots, sigmoid
from ..sources.scratch import settle
from .scale import exact_quantiles, expanding_quantiles, ordinal_rank, percentile_ranks
from .windows import top_k

DEADLINE = ("epoch", "period")


def _prior(part: Sequence[str], order: Sequence[str] = DEADLINE):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def prior_of(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0))


# ---------------------------------------------------------------- calibration

BINS = 10


def _bin_sums(probability: str, outcome: Column) -> list[Column]:
    b = F.least(F.floor(F.col(probability) * BINS), F.lit(BINS - 1))
    counts = [F.count(F.when(b == i, 1)).alias(f"n{i}") for i in range(BINS)]
    return counts + [F.coalesce(F.sum(F.when(b == i, outcome)), F.lit(0)).alias(f"s{i}") for i in range(BINS)]


def _isotonic_map(df: DataFrame, prior_rate: float, shrink: float, strength: float) -> DataFrame:
    """Adds `map`: Beta-shrunk bin rates made non-decreasing, from columns n0.. and s0...

    The weighted isotonic fit of bin b is the max over a <= b of the min over c >= b of the mean of a..c.
    """
    total_n = sum((F.col(f"n{i}") for i in range(1, BINS)), F.col("n0"))
    total_s = sum((F.col(f"s{i}") for i in range(1, BINS)), F.col("s0"))
    df = df.withColumn("_g", (total_s + strength * prior_rate) / (total_n + strength))
    sums = [(F.col(f"s{i}") + shrink * F.col("_g")) for i in range(BINS)]
    weights = [(F.col(f"n{i}") + shrink) for i in range(BINS)]
    means, where = [], {}
    for a in range(BINS):
        value, weight = F.lit(0.0), F.lit(0.0)
        for c in range(a, BINS):
            value, weight = value + sums[c], weight + weights[c]
            where[a, c] = len(means)
            means.append(value / weight)
    df = df.withColumn("_m", F.array(*means))
    fitted = []
    for b in range(BINS):
        lows = []
        for a in range(b + 1):
            spans = [F.col("_m")[where[a, c]] for c in range(b, BINS)]
            lows.append(F.least(*spans) if len(spans) > 1 else spans[0])
        fitted.append(clip(F.greatest(*lows) if len(lows) > 1 else lows[0], 0.005, 0.995))
    return df.withColumn("map", F.array(*fitted)).drop("_g", "_m", *[f"n{i}" for i in range(BINS)], *[f"s{i}" for i in range(BINS)])


def _apply_map(df: DataFrame, maps: DataFrame, keys: Sequence[str], probability: str, out: str, observed: Column, idle: float | None = None) -> DataFrame:
    b = F.least(F.floor(F.col(probability) * BINS), F.lit(BINS - 1)).cast("int")
    joined = df.join(maps, list(keys), "left")
    fallback = F.col(probability) if idle is None else F.when(observed, F.col(probability)).otherwise(F.lit(idle))
    return joined.withColumn(out, F.when(observed & F.col("map").isNotNull(), F.col("map")[b]).otherwise(fallback)).drop("map")


def expanding_calibration(
    df: DataFrame, stratum: str, probability: str, outcome: Column, prior_rate: float, observed: Column, out: str,
    shrink: float = 32.0, strength: float = 60.0, update_on: str = "all", idle: float | None = None,
) -> DataFrame:
    """Calibrate each deadline's observed rows with the isotonic map of strictly earlier ones.

    Other rows get `idle`, what is certain of a row with no slate, or keep their probability if it is not given.
    `update_on` says which rows teach later deadlines: 'all' or only the 'observed' ones.
    """
    taught = df if update_on == "all" else df.where(observed)
    keys = [stratum, *DEADLINE]
    sums = taught.groupBy(*keys).agg(*_bin_sums(probability, outcome))
    spine = df.select(*keys).distinct().join(sums, keys, "left")
    w = _prior([stratum])
    prior = spine.select(*keys, *[prior_of(f"{t}{i}", w).alias(f"{t}{i}") for t in "ns" for i in range(BINS)])
    return _apply_map(df, _isotonic_map(prior, prior_rate, shrink, strength), keys, probability, out, observed, idle)


def terminal_calibration(
    history: DataFrame, current: DataFrame, stratum: str, probability: str, outcome: Column, prior_rate: float,
    observed: Column, out: str, shrink: float = 32.0, strength: float = 60.0,
) -> DataFrame:
    """The same map from all of history (observed rows), applied to new rows."""
    sums = history.where(observed).groupBy(stratum).agg(*_bin_sums(probability, outcome))
    return _apply_map(current, _isotonic_map(sums, prior_rate, shrink, strength), [stratum], probability, out, F.lit(True))


def expanding_half_width(
    df: DataFrame, stratum: str, error: Column, uncertainty: str, observed: Column,
    level: float = 0.80, least: int = 250, default: float = 0.70, cells: int = 80, centre: str | None = None,
) -> DataFrame:
    """Adds `half_width`: uncertainty times the prior quantile of |error| / uncertainty; with a `centre` also its band `p10`, `p90`.

    A band is held in 0..25 and is 0 for rows that are not observed.
    The ratio is counted in twentieths up to 4; the quantile is the first cell whose running count
    reaches `level` of the rows, once there are `least` of them.
    """
    keys = [stratum, *DEADLINE]
    ratio = clip(F.abs(error) / F.greatest(F.col(uncertainty), F.lit(0.1)), 0.0, 4.0)
    cell = F.least(F.floor(ratio * 20), F.lit(cells)).cast("int")
    counted = df.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    spine = df.select(*keys).distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells))))
    prior = spine.join(counted, [*keys, "_cell"], "left").withColumn("_p", prior_of("_n", _prior([stratum, "_cell"])))
    at = Window.partitionBy(*keys)
    running = F.sum("_p").over(at.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    placed = prior.select(*keys, "_cell", running.alias("_run"), F.sum("_p").over(at).alias("_all"))
    found = placed.groupBy(*keys).agg(
        F.max("_all").alias("_all"), F.min(F.when(F.col("_run") >= level * F.col("_all"), F.col("_cell"))).alias("_at")
    )
    factor = F.when(F.col("_all") >= least, clip(F.col("_at") / 20.0, 0.25, 2.50)).otherwise(F.lit(default))
    ratios = found.select(*keys, factor.alias("_ratio"))
    width = clip(F.when(observed, F.col(uncertainty) * F.col("_ratio")).otherwise(F.lit(0.0)), 0.4, 9.0)
    out = df.join(ratios, keys).withColumn("half_width", width).drop("_ratio")
    return out if centre is None else _band(out, centre, observed)


def _band(df: DataFrame, centre: str, observed: Column) -> DataFrame:
    low, high = F.greatest(F.col(centre) - F.col("half_width"), F.lit(0.0)), F.least(F.col(centre) + F.col("half_width"), F.lit(25.0))
    return df.withColumn("p10", F.when(observed, low).otherwise(0.0)).withColumn("p90", F.when(observed, high).otherwise(0.0))


def terminal_half_width(
    history: DataFrame, current: DataFrame, stratum: str, error: Column, uncertainty: str, spread: str, centre: str, observed: Column,
    level: float = 0.80, default: float = 0.70,
) -> DataFrame:
    """The exact quantile of |error| / uncertainty over all of history (observed rows), times the `spread` of new rows; adds the band too."""
    ratio = clip(F.abs(error) / F.greatest(F.col(uncertainty), F.lit(0.1)), 0.0, 4.0)
    ratios = exact_quantiles(history.where(observed).select(stratum, ratio.alias("_ratio")), [stratum], {"_q": ("_ratio", level)})
    width = F.col(spread) * clip(F.coalesce("_q", F.lit(default)), 0.25, 2.50)
    return _band(current.join(ratios, stratum, "left").withColumn("half_width", width).drop("_q"), centre, F.lit(True))


# ---------------------------------------------------------------- ridge from sums

def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[Column], ys: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Sums of products of the features and targets per key: `g_i_j` (i <= j), `h_<y>_i`, and `rows`."""
    w = F.lit(1.0) if weight is None else weight
    named = df.select(*keys, w.alias("_w"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs)], *[y.cast("double").alias(f"_y_{n}") for n, y in ys.items()])
    k = len(xs)
    aggs = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(F.col("_w") * F.col(f"_y_{n}") * F.col(f"_x{i}")).alias(f"h_{n}_{i}") for n in ys for i in range(k)]
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *aggs)


def gram_columns(k: int, ys: Sequence[str]) -> list[str]:
    return ["rows", *[f"g_{i}_{j}" for i in range(k) for j in range(i, k)], *[f"h_{n}_{i}" for n in ys for i in range(k)]]


def _matrices(g: pd.Series, k: int) -> np.ndarray:
    flat = np.array(g.tolist(), dtype=float).reshape(-1, k * (k + 1) // 2)
    out = np.zeros((len(flat), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _packed(k: int, y: str) -> tuple[Column, Column]:
    g = F.array(*[F.coalesce(F.col(f"g_{i}_{j}"), F.lit(0.0)).cast("double") for i in range(k) for j in range(i, k)])
    return g, F.array(*[F.coalesce(F.col(f"h_{y}_{i}"), F.lit(0.0)).cast("double") for i in range(k)])


def ridge_solution(k: int, y: str, penalty: Sequence[float]) -> Column:
    """Coefficients of (G + diag(penalty)) b = h; one small solve per row of a table of sums."""
    diagonal = [float(p) for p in penalty]

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, h: pd.Series) -> pd.Series:
        left = _matrices(g, k) + np.diag(diagonal)
        right = np.array(h.tolist(), dtype=float).reshape(-1, k, 1)
        return pd.Series(list(np.linalg.solve(left, right)[..., 0]))

    return solve(*_packed(k, y))


def dot(xs: Sequence[Column], coefficients: Column) -> Column:
    total = F.lit(0.0)
    for i, x in enumerate(xs):
        total = total + x.cast("double") * coefficients[i]
    return total


def online_ridge(
    df: DataFrame, role: str, xs: Sequence[Column], target: Column, baseline: str, observed: Column, out: str,
    penalty: Sequence[float], least: int = 120, low: float = 0.15, high: float = 14.0, update_on: str = "all",
) -> DataFrame:
    """Ridge per role from strictly earlier deadlines; the baseline until there are `least` rows."""
    keys, k = [role, *DEADLINE], len(xs)
    taught = df if update_on == "all" else df.where(observed)
    sums = gram(taught, keys, xs, {"t": target})
    spine = df.select(*keys).distinct().join(sums, keys, "left")
    w = _prior([role])
    prior = spine.select(*keys, *[prior_of(c, w).alias(c) for c in gram_columns(k, ["t"])])
    fitted = prior.where(F.col("rows") >= least).withColumn("_b", ridge_solution(k, "t", penalty)).select(*keys, "_b")
    joined = df.join(fitted, keys, "left")
    ready = observed & F.col("_b").isNotNull()
    return joined.withColumn(out, F.when(ready, clip(dot(xs, F.col("_b")), low, high)).otherwise(F.col(baseline))).drop("_b")


def terminal_ridge(
    history: DataFrame, current: DataFrame, role: str, xs: Sequence[Column], target: Column, baseline: str, observed: Column,
    out: str, penalty: Sequence[float], decay: float = 0.72, least: int = 120, low: float = 0.15, high: float = 14.0,
) -> DataFrame:
    """Recency-weighted ridge per role over all of history, applied to new rows."""
    k = len(xs)
    per_epoch = gram(history.where(observed), [role, "epoch"], xs, {"t": target})
    last = Window.partitionBy()  # one row per role and epoch
    aged = per_epoch.withColumn("_w", F.pow(F.lit(decay), F.max("epoch").over(last) - F.col("epoch")))
    sums = [F.sum("rows").alias("rows"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in gram_columns(k, ["t"])[1:]]]
    fitted = aged.groupBy(role).agg(*sums).where(F.col("rows") >= least).withColumn("_b", ridge_solution(k, "t", penalty)).select(role, "_b")
    joined = current.join(fitted, role, "left")
    return joined.withColumn(
        out, F.when(F.col("_b").isNotNull(), clip(dot(xs, F.col("_b")), low, high)).otherwise(F.col(baseline))
    ).drop("_b")


def matured_ridge(
    df: DataFrame, stratum: str, xs: Sequence[Column], target: Column, end: str, baseline: str, out: str,
    penalty: Sequence[float], least_all: int = 1000, least_own: int = 350, own: float = 0.65, low: float = 0.25, high: float = 52.0,
) -> DataFrame:
    """Ridge on labels that have matured: a row teaches only after the last period its label uses.

    Prediction is `own` of the stratum fit and the rest of the global fit, once each has enough rows.
    """
    k = len(xs)
    matured = gram(df.withColumn("_end", F.col(end)), [stratum, "epoch", "_end"], xs, {"t": target}).withColumnRenamed("_end", "period")
    columns = gram_columns(k, ["t"])

    def prior_sums(events, part):
        spine = df.select(*part, *DEADLINE).distinct()
        merged = spine.join(events, [*part, *DEADLINE], "full")
        w = _prior(part)
        return merged.select(*part, *DEADLINE, *[prior_of(c, w).alias(c) for c in columns])

    own_fit = prior_sums(matured, [stratum]).where(F.col("rows") >= least_own).withColumn("_own", ridge_solution(k, "t", penalty))
    everyone = matured.groupBy(*DEADLINE).agg(*[F.sum(c).alias(c) for c in columns])
    all_fit = prior_sums(everyone, []).where(F.col("rows") >= least_all).withColumn("_all", ridge_solution(k, "t", penalty))
    joined = df.join(all_fit.select(*DEADLINE, "_all"), list(DEADLINE), "left").join(own_fit.select(stratum, *DEADLINE, "_own"), [stratum, *DEADLINE], "left")
    shared, mine = dot(xs, F.col("_all")), dot(xs, F.col("_own"))
    value = F.when(F.col("_all").isNull(), F.col(baseline)).when(F.col("_own").isNull(), shared).otherwise(own * mine + (1 - own) * shared)
    return joined.withColumn(out, clip(value, low, high)).drop("_all", "_own")


def _standardised_solution(k: int, y: str, alpha: float, positive: bool = False, scale: bool = True) -> Column:
    """Coefficients (intercept first, on raw features) of a ridge with an unpenalised intercept.

    Feature 0 must be the constant. Plain sums (`u_*`) give mean and spread for scaling; weighted
    sums give the fit. With `positive`, the best non-negative fit is found by trying every active set.
    """
    @F.pandas_udf("array<double>")
    def solve(plain: pd.Series, weighted: pd.Series, h: pd.Series) -> pd.Series:
        u, g = _matrices(plain, k), _matrices(weighted, k)
        rhs = np.array(h.tolist(), dtype=float).reshape(-1, k)
        out = []
        for u1, g1, h1 in zip(u, g, rhs):
            n = u1[0, 0]
            mean = u1[0, 1:] / n if scale else np.zeros(k - 1)
            spread = np.sqrt(np.maximum(np.diag(u1)[1:] / n - mean**2, 0)) if scale else np.ones(k - 1)
            spread = np.where(spread > 1e-12, spread, 1.0)
            w = g1[0, 0]
            centre, level = g1[0, 1:] / w, h1[0] / w
            a = (g1[1:, 1:] - w * np.outer(centre, centre)) / np.outer(spread, spread)
            c = (h1[1:] - w * centre * level) / spread
            b = _best_nonnegative(a, c, alpha) if positive else np.linalg.solve(a + alpha * np.eye(k - 1), c)
            raw = b / spread
            out.append(np.r_[level - raw @ centre, raw])
        return pd.Series(out)

    plain = F.array(*[F.coalesce(F.col(f"u_{i}_{j}"), F.lit(0.0)).cast("double") for i in range(k) for j in range(i, k)])
    return solve(plain, *_packed(k, y))


def _best_nonnegative(a: np.ndarray, c: np.ndarray, alpha: float) -> np.ndarray:
    k, best, least = len(c), np.zeros(len(c)), 0.0
    full = a + alpha * np.eye(k)
    for mask in range(1, 1 << k):
        active = [i for i in range(k) if mask >> i & 1]
        part = np.linalg.solve(full[np.ix_(active, active)], c[active])
        if (part >= 0).all():
            value = 0.5 * part @ full[np.ix_(active, active)] @ part - c[active] @ part
            if value < least - 1e-12:
                least, best = value, np.zeros(k)
                best[active] = part
    return best


def _aged_sums(per_epoch: DataFrame, keys: Sequence[str], epochs: DataFrame, columns: Sequence[str], decay: float) -> DataFrame:
    """Per target epoch: plain (`u_`) and age-weighted sums of the statistics of earlier epochs."""
    later = epochs.groupBy().agg(F.max("epoch").alias("_last")).withColumn("_k", F.lit(1))
    spread = per_epoch.withColumn("_k", F.lit(1)).join(F.broadcast(later), "_k").where(F.col("epoch") < F.col("_last"))
    spread = spread.withColumn("target", F.explode(F.sequence(F.col("epoch") + 1, F.col("_last"))))
    w = F.pow(F.lit(decay), F.col("target") - F.col("epoch") - 1)
    plain = [F.sum(c).alias("u" + c[1:]) for c in columns if c.startswith("g_")]
    return spread.groupBy(*keys, F.col("target").alias("epoch")).agg(
        F.sum("rows").alias("rows"), *plain, *[F.sum(w * F.col(c)).alias(c) for c in columns if c != "rows"]
    )


def _filled_row(name: str, xs: Sequence[str]) -> list[Column]:
    """Sums `name`_i of 1 and the filled features, from those of 1 and the pairs (value, missing) of each."""
    at = lambda i: F.coalesce(F.col(f"{name}_{i}"), F.lit(0.0))
    return [at(0), *[at(2 * k + 1) + F.coalesce(F.col(f"_m_{x}"), F.lit(0.0)) * at(2 * k + 2) for k, x in enumerate(xs)]]


def _filled(name: str, xs: Sequence[str]) -> list[Column]:
    """Sums of products of the filled features, from those of their parts."""
    at = lambda i, j: F.coalesce(F.col(f"{name}_{min(i, j)}_{max(i, j)}"), F.lit(0.0))
    parts = [[(0, F.lit(1.0))], *[[(2 * k + 1, F.lit(1.0)), (2 * k + 2, F.coalesce(F.col(f"_m_{x}"), F.lit(0.0)))] for k, x in enumerate(xs)]]
    return [sum((w * v * at(a, b) for a, w in left for b, v in parts[j]), F.lit(0.0)).alias(f"{name}_{i}_{j}") for i, left in enumerate(parts) for j in range(i, len(parts))]


def season_ahead_ridge(
    df: DataFrame, stratum: str, xs: Sequence[str], targets: Sequence[str], train: Column, observed: Column,
    outs: Sequence[str], baselines: Sequence[str], alpha: float = 80.0, decay: float = 0.88, low: float = 0.0, high: float = 70.0,
    impute: bool = False,
) -> DataFrame:
    """Ridge per (epoch, stratum) on all earlier epochs, several targets at once.

    Features are scaled on the training rows; weights fall with age in epochs. With `impute`, a
    missing feature takes its training median of all earlier epochs.
    Without earlier epochs the baseline stands; unobserved rows are zero.
    """
    k = len(xs) + 1
    columns = gram_columns(k, list(targets))
    rows = df.where(train)
    work = df
    if impute:
        asks = df.select(stratum, "epoch").distinct().select(stratum, "epoch", F.explode(F.array(*[F.lit(x) for x in xs])).alias("_name"), F.lit(0.5).alias("q"))
        long = rows.select(stratum, "epoch", F.explode(F.array(*[F.struct(F.lit(x).alias("_name"), F.col(x).cast("double").alias("_value")) for x in xs])).alias("_e")).select(stratum, "epoch", "_e.*")
        medians = expanding_quantiles(long, [stratum, "_name"], "epoch", "_value", asks, "_median")
        medians = settle(medians.groupBy(stratum, "epoch").agg(*[F.max(F.when(F.col("_name") == x, F.col("_median"))).alias(f"_m_{x}") for x in xs]), "medians")
        # a filled feature is value + median * missing, so its moments follow from those of values and marks of what is missing
        parts = [F.lit(1.0), *[part for x in xs for part in (F.coalesce(F.col(x).cast("double"), F.lit(0.0)), F.col(x).isNull().cast("double"))]]
        raw = gram(rows, [stratum, "epoch"], parts, {t: F.col(t) for t in targets})
        aged = _aged_sums(raw, [stratum], df.select("epoch"), gram_columns(len(parts), list(targets)), decay).join(medians, [stratum, "epoch"])
        sums = aged.select(stratum, "epoch", "rows", *_filled("g", xs), *_filled("u", xs), *[c.alias(f"h_{t}_{i}") for t in targets for i, c in enumerate(_filled_row(f"h_{t}", xs))])
        work = df.join(medians, [stratum, "epoch"], "left")
        scored = [F.lit(1.0), *[F.coalesce(F.col(x).cast("double"), F.col(f"_m_{x}"), F.lit(0.0)) for x in xs]]
    else:
        scored = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
        per_epoch = gram(rows, [stratum, "epoch"], scored, {t: F.col(t) for t in targets})
        sums = _aged_sums(per_epoch, [stratum], df, columns, decay)
    fits = sums.select(stratum, "epoch", *[_standardised_solution(k, t, alpha).alias(f"_b_{t}") for t in targets])
    joined = work.join(fits, [stratum, "epoch"], "left")
    for t, out, base in zip(targets, outs, baselines):
        b = F.col(f"_b_{t}")
        value = F.when(b.isNotNull(), clip(dot(scored, b), low, high)).otherwise(F.col(base))
        joined = joined.withColumn(out, F.when(observed, value).otherwise(F.lit(0.0)))
    return joined.select(*df.columns, *[o for o in outs if o not in df.columns])


def checkpoint_ridge(
    df: DataFrame, stratum: str, xs: Sequence[str], target: str, end: str, step: str, checkpoints: Sequence[int],
    train: Column, observed: Column, out: str, baseline: str, alpha: float = 80.0, decay: float = 0.88, fresh: float = 1.35,
) -> DataFrame:
    """`season_ahead_ridge` refitted at checkpoints of the epoch with its labels matured so far.

    `step` and `end` are positions within the epoch; rows of the current epoch count `fresh` times.
    """
    k = len(xs) + 1
    columns = gram_columns(k, [target])
    features = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    points = sorted(checkpoints)
    rows = df.where(train)
    old = _aged_sums(gram(rows, [stratum, "epoch"], features, {target: F.col(target)}), [stratum], df, columns, decay)
    # a row joins at the first checkpoint after its label's last period, and stays
    join_at = first_match([(F.col(end) < c, c) for c in points], None).cast("int")
    now = gram(rows.withColumn("_c", join_at).where(F.col("_c").isNotNull()), [stratum, "epoch", "_c"], features, {target: F.col(target)})
    later = F.filter(F.array(*[F.lit(c) for c in points]), lambda c: c >= F.col("_c"))
    now = now.withColumn("_c", F.explode(later)).groupBy(stratum, "epoch", "_c").agg(*[F.sum(c).alias(f"c_{c}") for c in columns])
    spine = df.where(F.col("epoch") > 0).select(stratum, "epoch").distinct().withColumn("_c", F.explode(F.array(*[F.lit(c) for c in points])))
    both = spine.join(old, [stratum, "epoch"], "left").join(now, [stratum, "epoch", "_c"], "left")

    def added(name, base, weight):
        return (F.coalesce(F.col(base), F.lit(0.0)) + weight * F.coalesce(F.col(f"c_{name}"), F.lit(0.0)))

    # age -1 of the current epoch is floored at zero, so its weight is `fresh`
    sums = both.select(
        stratum, "epoch", "_c", added("rows", "rows", 1.0).alias("rows"),
        *[added(c, "u" + c[1:], 1.0).alias("u" + c[1:]) for c in columns if c.startswith("g_")],
        *[added(c, c, fresh).alias(c) for c in columns if c != "rows"],
    ).where(F.col("rows") > k)
    fits = sums.select(stratum, "epoch", "_c", _standardised_solution(k, target, alpha).alias("_b"))
    at = first_match([(F.col(step) >= c, c) for c in reversed(points)], None).cast("int")
    joined = df.withColumn("_c", at).join(fits, [stratum, "epoch", "_c"], "left")
    value = F.when(F.col("_b").isNotNull(), clip(dot(features, F.col("_b")), 0.0, 70.0)).otherwise(F.col(baseline))
    return joined.withColumn(out, F.when(observed, value).otherwise(F.lit(0.0))).drop("_b", "_c")


def stacked_ranks(
    df: DataFrame, group: Sequence[str], entity: str, stratum: str, models: Sequence[str], target: str, train: Column,
    observed: Column, out: str, alpha: float = 90.0, decay: float = 0.88, least_epochs: int = 3,
) -> DataFrame:
    """Weights per (epoch, stratum) of a non-negative ridge on in-group ranks, and the stacked rank.

    Weights are scaled to sum to one (even when all are zero: equal); before `least_epochs` the first model stands.
    """
    ranked = percentile_ranks(df, group, {m: f"_r_{m}" for m in models} | {target: "_t"}, ids=[entity])
    xs = [F.lit(1.0), *[F.col(f"_r_{m}") for m in models]]
    k = len(xs)
    per_epoch = gram(ranked.where(train), [stratum, "epoch"], xs, {"t": F.col("_t")})
    sums = _aged_sums(per_epoch, [stratum], df, gram_columns(k, ["t"]), decay).where(F.col("epoch") >= least_epochs)
    fits = sums.select(stratum, "epoch", _standardised_solution(k, "t", alpha, positive=True, scale=False).alias("_b"))
    total = sum((F.col("_b")[i] for i in range(2, k)), F.col("_b")[1])
    equal = F.array(*[F.lit(1.0 / len(models))] * len(models))
    weights = F.when(total > 1e-8, F.array(*[F.col("_b")[i] / total for i in range(1, k)])).otherwise(equal)
    joined = ranked.join(fits.select(stratum, "epoch", weights.alias("weights")), [stratum, "epoch"], "left")
    value = F.when(F.col("weights").isNull(), F.col(f"_r_{models[0]}")).otherwise(dot(xs[1:], F.col("weights")))
    return joined.withColumn(out, F.when(observed, value).otherwise(F.lit(0.0))).drop("_t", *[f"_r_{m}" for m in models])


# ---------------------------------------------------------------- ensembles and blends

def inverse_error_weights(df: DataFrame, stratum: str, models: dict[str, float], actual: str, observed: Column) -> DataFrame:
    """Adds `w_<model>`: inverse squared prior mean absolute error per stratum, scaled to sum to one.

    `models` maps a model column to its error before any deadline; errors are held in 1.4..6.
    """
    keys = [stratum, *DEADLINE]
    names = list(models)
    weekly = df.groupBy(*keys).agg(*[F.avg(F.when(observed, F.abs(F.col(m) - F.col(actual)))).alias(f"_e{i}") for i, m in enumerate(names)])
    w = _prior([stratum])
    held = weekly.select(*keys, *[
        (1 / F.pow(clip(F.coalesce(F.avg(f"_e{i}").over(w), F.lit(models[m])), 1.4, 6.0), 2)).alias(f"_i{i}") for i, m in enumerate(names)
    ])
    total = sum((F.col(f"_i{i}") for i in range(1, len(names))), F.col("_i0"))
    shares = held.select(*keys, *[(F.col(f"_i{i}") / total).alias(f"w_{m}") for i, m in enumerate(names)])
    return df.join(shares, keys)


def blend_search(
    df: DataFrame, first: str, second: str, actual: str, probability: bool = False, steps: int = 20, shrink: float = 380.0, default: float = 0.5,
) -> DataFrame:
    """Per epoch the weight of the second source, chosen on earlier epochs and shrunk to the default.

    All grid losses are summed in one pass per epoch; the smallest weight wins ties.
    """
    grid = [i / steps for i in range(steps + 1)]
    a = F.col(actual).cast("double")

    def loss(weight):
        if probability:
            gap = probability_blend(first, second, weight) - a
            return gap * gap
        p = F.greatest(geometric_blend(first, second, weight), F.lit(0.02))
        return 2.0 * (F.when(a > 0, a * F.log(a / p)).otherwise(0.0) - (a - p))

    sums = df.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), *[F.sum(loss(g)).alias(f"l{i}") for i, g in enumerate(grid)])
    w = Window.partitionBy().orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # one row per epoch
    prior = sums.select("epoch", prior_of("n", w).alias("n"), *[prior_of(f"l{i}", w).alias(f"l{i}") for i in range(len(grid))])
    # losses are compared after rounding so that equal ones tie whatever the order of addition
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"l{i}"), 6).alias("l"), F.lit(g).alias("w")) for i, g in enumerate(grid)]))["w"]
    share = F.col("n") / (F.col("n") + shrink)
    chosen = F.when(F.col("n") > 0, share * best + (1 - share) * default).otherwise(F.lit(default))
    return prior.select("epoch", F.col("n").alias("prior_rows"), chosen.alias("weight"))


def expert_weights(
    df: DataFrame, stratum: str, base: str, challenger: str, actual: str, entity: str, observed: Column,
    decay: float, temperature: float, k: int | dict[int, int], end: str | None = None,
) -> DataFrame:
    """Weight of a challenger per (stratum, deadline) from its earlier top-k advantage; `k` is one number or one per stratum.

    The advantage decays by `decay` per deadline from zero; the weight is a sigmoid around one
    quarter, held in .05..0.50. With `end`, an advantage counts once all its labels have matured.
    """
    keys = [stratum, *DEADLINE]
    seen = df.where(observed)

    quota = first_match([(F.col(stratum) == s, n) for s, n in k.items()], 0) if isinstance(k, dict) else F.lit(k)
    most = max(k.values()) if isinstance(k, dict) else k

    def top_mean(score, name):
        best = top_k(seen, keys, [F.desc(score), F.asc(entity)], most, "_r").where(F.col("_r") <= quota)
        return best.groupBy(*keys).agg(F.avg(actual).alias(name))

    gained = top_mean(challenger, "_c").join(top_mean(base, "_b"), keys).select(*keys, (F.col("_c") - F.col("_b")).alias("_adv"))
    if end is not None:
        gained = gained.join(seen.groupBy(*keys).agg(F.max(end).alias("_end")), keys)
    else:
        gained = gained.withColumn("_end", F.col("period"))
    spine = df.select(*keys).distinct().join(gained, keys, "left")
    past = F.collect_list(F.struct(F.col("epoch").alias("e"), F.col("_end").alias("p"), F.col("_adv").alias("a"))).over(_prior([stratum]))
    held = spine.withColumn("_past", past)
    matured = F.filter(
        F.col("_past"), lambda x: x["a"].isNotNull() & ((x["e"] < F.col("epoch")) | ((x["e"] == F.col("epoch")) & (x["p"] < F.col("period"))))
    )
    state = F.aggregate(matured, F.lit(0.0), lambda s, x: decay * s + (1 - decay) * x["a"])
    weight = clip(sigmoid(F.log(F.lit(0.25 / 0.75)) + state / temperature), 0.05, 0.50)
    return held.select(*keys, state.alias("advantage"), weight.alias("weight"))


# Last rank of each bucket but the open one.
RANK_ENDS = (3, 8, 15, 30)


def selection_bias(
    df: DataFrame, stratum: str, forecast: str, target: str, end: str, entity: str, observed: Column, pool: float = 80.0,
) -> DataFrame:
    """Bias of a row's rank bucket against its stratum, from labels matured before the deadline.

    Bucket means are pooled with `pool` rows of the all-strata bucket mean. Adds `bucket` and `bias`.
    """
    keys = [stratum, *DEADLINE]
    top = top_k(df.where(observed), keys, [F.desc(forecast), F.asc(entity)], RANK_ENDS[-1], "_r").select(*keys, entity, "_r")
    last = len(RANK_ENDS)
    bucket = first_match([(F.col("_r") <= end_, i) for i, end_ in enumerate(RANK_ENDS)], last)
    placed = df.join(top, [*keys, entity], "left").withColumn("bucket", F.when(observed, bucket).otherwise(F.lit(last))).drop("_r")
    matured = placed.where(observed).groupBy(stratum, "epoch", F.col(end).alias("period"), "bucket").agg(
        F.sum(F.col(forecast) - F.col(target)).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    buckets = F.explode(F.array(*[F.lit(i) for i in range(last + 1)])).alias("bucket")
    spine = placed.select(*keys).distinct().select(*keys, buckets)
    # strata x deadlines x buckets rows from here on
    merged = spine.join(matured, [*keys, "bucket"], "full")
    own = merged.select(*keys, "bucket", prior_of("_s", _prior([stratum, "bucket"])).alias("s"), prior_of("_n", _prior([stratum, "bucket"])).alias("n"))
    wide = matured.groupBy(*DEADLINE, "bucket").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    moments = placed.select(*DEADLINE).distinct().select(*DEADLINE, buckets).join(wide, [*DEADLINE, "bucket"], "full")
    pooled = moments.select(*DEADLINE, "bucket", prior_of("_s", _prior(["bucket"])).alias("gs"), prior_of("_n", _prior(["bucket"])).alias("gn"))
    both = own.join(pooled, [*DEADLINE, "bucket"])
    at_stratum, at_all = Window.partitionBy(*keys), Window.partitionBy(*keys)
    both = both.select(
        "*", F.sum("s").over(at_stratum).alias("ps"), F.sum("n").over(at_stratum).alias("pn"),
        F.sum("gs").over(at_all).alias("as_"), F.sum("gn").over(at_all).alias("an"),
    )
    overall = F.when(F.col("an") > 0, F.col("as_") / F.col("an")).otherwise(F.lit(0.0))
    bucket_mean = F.when(F.col("gn") > 0, F.col("gs") / F.col("gn")).otherwise(overall)
    stratum_mean = F.when(F.col("pn") > 0, F.col("ps") / F.col("pn")).otherwise(overall)
    local = (F.col("s") + pool * bucket_mean) / (F.col("n") + pool)
    table = both.select(*keys, "bucket", (local - stratum_mean).alias("_bias"))
    joined = placed.join(table, [*keys, "bucket"], "left")
    return joined.withColumn("bias", F.when(observed, F.col("_bias")).otherwise(F.lit(0.0))).drop("_bias")


def _mapped(df: DataFrame, group: Sequence[str], entity: str, challenger: str, reference: str) -> DataFrame:
    """Adds `_value`, the reference value at the challenger's place, and the place `_rn` of `_rn_of`."""
    group = list(group)
    placed = ordinal_rank(df, group, challenger, entity, "_rn")
    thin = df.select(*group, entity, F.col(reference).alias("_value"))
    ladder = ordinal_rank(thin, group, "_value", entity, "_rn").select(*group, "_rn", "_value")
    return placed.join(ladder, [*group, "_rn"])


def quantile_map(
    df: DataFrame, group: Sequence[str], entity: str, challenger: str, reference: str, out: str, slate: str | None = None,
) -> DataFrame:
    """Give the challenger's order the reference's sorted values; zero-slate rows are then zero."""
    joined = _mapped(df, group, entity, challenger, reference)
    value = F.col("_value") if slate is None else F.when(F.col(slate) == 0, F.lit(0.0)).otherwise(F.col("_value"))
    return joined.withColumn(out, value).drop("_value", "_rn", "_rn_of")


def rank_consensus(
    df: DataFrame, group: Sequence[str], entity: str, frozen: str, others: Sequence[str], share: float, tie_break: Column, active: Column, out: str,
) -> DataFrame:
    """Frozen rank mixed with the mean rank of others less a small tie-break, where active."""
    names = {frozen: "_rf"} | {o: f"_r{i}" for i, o in enumerate(others)}
    ranked = percentile_ranks(df, group, names, fill=None, ids=[entity])
    mean = sum((F.col(f"_r{i}") for i in range(1, len(others))), F.col("_r0")) / len(others)
    mixed = (1 - share) * F.col("_rf") + share * mean - tie_break
    return ranked.withColumn(out, F.when(active, mixed).otherwise(F.col("_rf"))).drop(*names.values())


def agreement_blend(base, first_rank, base_rank, second_rank, challenger, event, share: float, dead_zone: float, start: int = 13, continuous: bool = False) -> Column:
    """Move to the challenger where two ranks move the same way, far enough, late enough."""
    d1, d2 = col(first_rank) - col(base_rank), col(second_rank) - col(base_rank)
    agreed = (F.signum(d1) == F.signum(d2)) & (F.abs(d1) >= dead_zone) & (col(event) >= start)
    strength = clip((F.abs(d1) - dead_zone) / max(0.01, 0.35 - dead_zone), 0.0, 1.0) if continuous else F.lit(1.0)
    return col(base) + F.when(agreed, share * strength).otherwise(F.lit(0.0)) * (col(challenger) - col(base))


def vote_blend(base, mapped: Sequence, share: float, threshold: float) -> tuple[Column, Column]:
    """Move to the median of several challengers where enough of them move the same way."""
    ups = [F.when(col(m) > col(base), 1.0).otherwise(0.0) for m in mapped]
    downs = [F.when(col(m) < col(base), 1.0).otherwise(0.0) for m in mapped]
    n = len(mapped)
    vote = F.greatest(sum(ups[1:], ups[0]) / n, sum(downs[1:], downs[0]) / n)
    ordered = F.array_sort(F.array(*[col(m) for m in mapped]))
    middle = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
    return col(base) + F.when(vote >= threshold, share).otherwise(0.0) * (middle - col(base)), vote


def phase_blend(base, challenger, event, start: int, share: float) -> Column:
    """Fixed share of the challenger from an event on."""
    return F.when(col(event) >= start, (1 - share) * col(base) + share * col(challenger)).otherwise(col(base))


def relevance(points) -> Column:
    """Whole-number relevance 0..15, halves to even."""
    return clip(F.rint(col(points)), 0.0, 15.0)


def query_group(epoch, period, price, band: int = 10, shift: int = 0) -> Column:
    """Name of the deadline and price band a row is ranked in."""
    return F.concat_ws("-", col(epoch), col(period), F.floor((col(price) + shift) / band))


def residual_band(
    df: DataFrame, stratum: str, uncertainty: str, residual: Column, train: Column, bins: int = 5, low: float = 0.10, high: float = 0.90, default: float = 0.80,
) -> DataFrame:
    """Residual quantiles of earlier epochs by stratum and uncertainty bin; adds `lower` and `upper`.

    Bin edges too come from earlier epochs. Without any, the band is +/- default * uncertainty.
    """
    rows = df.where(train).select(stratum, "epoch", F.col(uncertainty).alias("_u"), residual.alias("_res"))
    fits = df.select(stratum, "epoch").distinct()
    cuts = fits.withColumn("q", F.explode(F.array(*[F.lit(i / bins) for i in range(1, bins)])))
    edges = expanding_quantiles(rows, [stratum], "epoch", "_u", cuts, "_edge").where(F.col("_edge").isNotNull())
    edges = settle(edges.groupBy(stratum, "epoch").agg(F.sort_array(F.collect_list("_edge")).alias("_edges")), "band-edges")
    ends = F.concat(F.array(F.lit(float("-inf"))), "_edges", F.array(F.lit(float("inf"))))
    spans = F.transform(F.sequence(F.lit(0), F.size("_edges")), lambda b: F.struct(b.alias("_bin"), F.get(ends, b).alias("low"), F.get(ends, b + 1).alias("high")))
    both = edges.select(stratum, "epoch", F.explode(spans).alias("_s")).select(stratum, "epoch", "_s.*", F.explode(F.array(F.lit(low), F.lit(high))).alias("q"))
    rows = rows.withColumn("_u", F.coalesce("_u", F.lit(-1e308)))  # a row without an uncertainty is in the first bin
    found = expanding_quantiles(rows, [stratum], "epoch", "_res", both, "_end", side="_u")
    bands = found.groupBy(stratum, "epoch", "_bin").agg(F.max(F.when(F.col("q") == low, F.col("_end"))).alias("_lo"), F.max(F.when(F.col("q") == high, F.col("_end"))).alias("_hi"))
    asked = df.join(edges, [stratum, "epoch"], "left").withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(uncertainty))))
    joined = asked.join(bands, [stratum, "epoch", "_bin"], "left")
    wide = default * F.col(uncertainty)
    return joined.select(
        *df.columns, F.coalesce(F.least("_lo", "_hi"), -wide).alias("lower"), F.coalesce(F.greatest("_lo", "_hi"), wide).alias("upper")
    )


def blend_scores(df: DataFrame, models: Sequence[str], blends: dict[str, Sequence[float]], actual: str, entity: str, observed: Column, least: int = 20, k: int = 15) -> DataFrame:
    """Additive parts of the selection score per (blend, epoch)."""
    mixes = [F.struct(F.lit(n).alias("blend"), sum((float(w) * F.col(m) for w, m in zip(ws[1:], models[1:])), float(ws[0]) * F.col(models[0])).alias("f")) for n, ws in blends.items()]
    rows = df.where(observed).select("epoch", "period", entity, F.col(actual).alias("a"), F.explode(F.array(*mixes)).alias("_m"))
    rows = rows.select("epoch", "period", entity, "a", "_m.blend", "_m.f")
    gap = F.abs(F.col("f") - F.col("a"))
    errors = rows.groupBy("blend", "epoch").agg(
        F.sum(gap).alias("err"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") > 2, gap)).alias("high_err"), F.count(F.when(F.col("a") > 2, 1)).alias("high_n")
    )
    keys = ["blend", "epoch", "period"]
    big = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least).drop("_rows")
    top = top_k(rows, keys, [F.desc("f"), F.asc(entity)], k, "_r").groupBy(*keys).agg(F.avg("a").alias("_top")).join(big, keys)
    ranked = percentile_ranks(rows, keys, {"f": "_rf", "a": "_ra"}, fill=None, ids=[entity]).groupBy(*keys).agg(F.corr("_rf", "_ra").alias("_rho")).join(big, keys)
    defined = F.col("_rho").isNotNull() & ~F.isnan("_rho")
    per = top.join(ranked, keys).groupBy("blend", "epoch").agg(
        F.sum("_top").alias("top"), F.count("_top").alias("groups"), F.sum(F.when(defined, F.col("_rho"))).alias("rho"), F.count(F.when(defined, 1)).alias("rho_n")
    )
    return errors.join(per, ["blend", "epoch"], "left")


def select_blend(parts: DataFrame, first_epoch: int = 1) -> DataFrame:
    """Per epoch the blend of lowest score on earlier epochs from `first_epoch` on.

    Score: error + .35 * error on returns - 1.2 * rank correlation - .08 * top-15 points.
    """
    names = ["err", "n", "high_err", "high_n", "top", "groups", "rho", "rho_n"]
    used = parts.select("blend", "epoch", *[F.when(F.col("epoch") >= first_epoch, F.col(c)).alias(c) for c in names])
    w = Window.partitionBy("blend").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prior = used.select("blend", "epoch", *[prior_of(c, w).alias(c) for c in names]).where(F.col("n") > 0)

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    score = ratio("err", "n") + 0.35 * ratio("high_err", "high_n") - 1.20 * ratio("rho", "rho_n") - 0.08 * ratio("top", "groups")
    scored = prior.select("epoch", "blend", F.round(score, 9).alias("score"))
    return scored.groupBy("epoch").agg(F.min_by(F.struct("blend", "score"), F.struct("score", "blend")).alias("_b")).select("epoch", F.col("_b.blend").alias("blend"), F.col("_b.score").alias("score"))


def nested_choice(scores: DataFrame, policy: str, value: str, training: int = 2, penalty: float = 0.25, standardise: bool = True) -> DataFrame:
    """Per later epoch: the policy best on earlier ones, its score, the static choice and the oracle.

    scores: one row per policy and epoch. Ties go to the smaller policy name.
    """
    s = F.col(value).cast("double")
    every = Window.partitionBy("epoch")
    z = (s - F.avg(s).over(every)) / F.greatest(F.stddev_pop(s).over(every), F.lit(1e-6)) if standardise else s
    w = Window.partitionBy(policy).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    marked = scores.select(policy, "epoch", s.alias("_s"), z.alias("_z"))
    stable = F.round(F.avg("_z").over(w) - penalty * F.stddev_pop("_z").over(w), 9)
    number = F.count("_z").over(w)
    ready = marked.select(policy, "epoch", "_s", "_z", stable.alias("_stable"), number.alias("_n"))
    trained = ready.where(F.col("_n") < training).groupBy(policy).agg(F.round(F.avg("_z") - penalty * F.stddev_pop("_z"), 9).alias("_static"))
    joined = ready.where(F.col("_n") >= training).join(trained, policy)
    w_best = Window.partitionBy("epoch")

    def pick(order):
        return F.row_number().over(w_best.orderBy(F.desc(order), F.asc(policy)))

    placed = joined.select("*", pick("_stable").alias("_a"), pick("_static").alias("_b"))
    return placed.groupBy("epoch").agg(
        F.max(F.when(F.col("_a") == 1, F.col(policy))).alias("selected"), F.max(F.when(F.col("_a") == 1, F.col("_s"))).alias("points"),
        F.max(F.when(F.col("_b") == 1, F.col(policy))).alias("static"), F.max(F.when(F.col("_b") == 1, F.col("_s"))).alias("static_points"),
        F.max("_s").alias("oracle_points"),
    )


def candidate_forecasts(df: DataFrame, features: Sequence[str], candidates: dict[str, Sequence[float]], idle: Sequence[int], current: str, horizon: str, risk: Column, option: Column, upside: Column) -> DataFrame:
    """Rows per candidate: model score, calibrated current value and risk-adjusted plan.

    The multiplier is .72 + .56 * score with the idle weights zeroed and the rest rescaled.
    """
    entries = []
    for name, weights in candidates.items():
        kept = [0.0 if i in idle else float(w) for i, w in enumerate(weights)]
        total = sum(kept)
        kept = [w / total for w in kept] if total > 0 else kept
        score = sum((float(w) * F.col(f) for w, f in zip(weights[1:], features[1:])), float(weights[0]) * F.col(features[0]))
        level = 0.72 + 0.56 * sum((w * F.col(f) for w, f in zip(kept[1:], features[1:])), kept[0] * F.col(features[0]))
        plan = F.col(horizon) * level - 0.10 * risk + 0.32 * option + 0.20 * upside
        entries.append(F.struct(F.lit(name).alias("candidate"), score.alias("score"), (F.col(current) * level).alias("current"), plan.alias("plan")))
    return df.withColumn("_c", F.explode(F.array(*entries))).select(*df.columns, "_c.*")


def sample_weights(df: DataFrame, keys: Sequence[str], age: Column, points: str, out: str, decay: float = 0.86) -> DataFrame:
    """Age decay times 1.65 for hauls and 1.25 for returns, scaled to mean one per key."""
    p = F.col(points)
    raw = F.pow(F.lit(decay), F.greatest(age - 1, F.lit(0))) * F.when(p >= 8, 1.65).when(p >= 5, 1.25).otherwise(1.0)
    weighted = df.withColumn("_raw", raw)
    mean = weighted.groupBy(*keys).agg(F.avg("_raw").alias("_mean"))
    return weighted.join(mean, list(keys)).withColumn(out, F.col("_raw") / F.col("_mean")).drop("_raw", "_mean")


def tenure_target(tenure, targets: dict[int, str], ends: dict[int, str]) -> tuple[Column, Column]:
    """Label interpolated at the tenure between horizon knots, and the last period it relies on.

    The label matures with the knot above the tenure: a tenure of 3.1 needs the next one.
    """
    knots = sorted(targets)
    value = interpolate_knots(tenure, [float(k) for k in knots], [F.col(targets[k]) for k in knots])
    rules = [(col(tenure) > low, F.col(ends[high])) for low, high in reversed(list(zip(knots[1:], knots[2:])))]
    return value, first_match(rules, F.col(ends[knots[1]]))


def map_to_reference(df: DataFrame, group: Sequence[str], entity: str, raw: str, reference: str) -> DataFrame:
    """Challenger order on the reference scale, with its place in the group from 0 to 100."""
    joined = _mapped(df, group, entity, raw, reference)
    place = F.when(F.col("_rn_of") > 1, 100.0 * (F.col("_rn") - 1) / (F.col("_rn_of") - 1)).otherwise(F.lit(0.0))
    return joined.withColumn("mapped", F.col("_value")).withColumn("percentile", place).drop("_value", "_rn", "_rn_of")


def top_ensemble(scores: DataFrame, name: str, value: str, parameters: DataFrame, seed: str, best: int = 12, penalty: float = 0.25) -> DataFrame:
    """Per epoch the mean parameters of the candidates most stable before it; the first uses a seed.

    parameters: (name, <doubles>), one row per candidate.
    """
    w = Window.partitionBy(name).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col(value)
    stable = scores.select(name, "epoch", F.round(F.avg(s).over(w) - penalty * F.stddev_pop(s).over(w), 9).alias("_stable"), F.count(s).over(w).alias("_n"))
    chosen = top_k(stable.where(F.col("_n") > 0), ["epoch"], [F.desc("_stable"), F.asc(name)], best, "_r").select("epoch", name)
    start = stable.where((F.col("_n") == 0) & (F.col(name) == seed)).select("epoch", name)
    values = [c for c in parameters.columns if c != name]
    return chosen.unionByName(start).join(parameters, name).groupBy("epoch").agg(F.count(F.lit(1)).alias("members"), *[F.avg(v).alias(v) for v in values])
