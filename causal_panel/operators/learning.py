"""Walk-forward fits with MLlib: one distributed fit per epoch (and stratum), earlier epochs only.

The driver loops over epochs, of which there are few; rows never leave the executors. Training rows
are written once and read by every fit.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources.scratch import settle
from .estimators import season_ahead_ridge
from .newton import Glm, expanding_glms, fitted, predict
from .scale import exact_quantiles, expanding_quantiles


def epochs_of(df: DataFrame, epoch: str = "epoch") -> list[int]:
    """The distinct epochs in order (a handful)."""
    return [r[0] for r in df.select(epoch).distinct().orderBy(epoch).collect()]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def walk_forward_trees(
    df: DataFrame, xs: Sequence[str], target: str, observed: Column, baseline: str, out: str, points: str, low: float = 0.0, high: float = 20.0,
    trees: int = 20, depth: int = 4, seed: int = 17, strata: str | None = None, labels: tuple[float, float] | None = None,
) -> DataFrame:
    """Boosted trees per epoch (and stratum) on earlier epochs, recency and consequence weighted; labels are held in `labels`, if given.

    The first epoch keeps the baseline; unobserved rows are zero.
    """
    build = VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="error")
    ready = settle(build.transform(df), "features")
    parts = []
    values = [None] if strata is None else [r[0] for r in df.select(strata).distinct().orderBy(strata).collect()]
    for i, e in enumerate(epochs_of(df)):
        for v in values:
            mine = F.lit(True) if v is None else F.col(strata) == v
            here = ready.where((F.col("epoch") == e) & mine)
            if i == 0:
                parts.append(here.withColumn(out, F.col(baseline)))
                continue
            train = _weighted(ready.where((F.col("epoch") < e) & observed & mine), e, points).withColumn("_label", clip(F.col(target).cast("double"), *(labels or ())))
            model = GBTRegressor(featuresCol="_x", labelCol="_label", weightCol="_w", predictionCol=out, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed + e).fit(train)
            parts.append(model.transform(here))
    joined = _union(parts).drop("_x")
    return joined.withColumn(out, F.when(observed, clip(F.col(out).cast("double"), low, high)).otherwise(F.lit(0.0)))


def _weighted(train: DataFrame, epoch: int, points: str) -> DataFrame:
    p = F.col(points)
    age = F.greatest(F.lit(epoch) - F.col("epoch") - 1, F.lit(0))
    return train.withColumn("_w", F.pow(F.lit(0.86), age) * F.when(p >= 8, 1.65).when(p >= 5, 1.25).otherwise(1.0))


def market_models(decay: float = 0.90) -> list[Glm]:
    return [Glm("goals", "_scored", "poisson", 0.35, decay, of_mean=True), Glm("clean", "_clean", "logistic", 1 / 0.45, decay)]


def market_model(sides: DataFrame, xs: Sequence[str], swapped: dict[str, Column], scored: str, clean: Column, first: int, decay: float = 0.90) -> DataFrame:
    """Poisson rates of goals for and against and the clean-sheet chance per side, from earlier epochs.

    The chance mixes .55 of the zero probability under the opponent's rate (the same model on the
    swapped features) with .45 of a logistic fit. `swapped` gives each feature from the other side.
    Epochs before `first` are kept without an estimate.
    """
    own = settle(sides.withColumn("_clean", clean.cast("double")).withColumn("_scored", F.col(scored).cast("double")), "sides")
    fits = expanding_glms(own, xs, market_models(decay), own.select("epoch").where(F.col("epoch") >= first))
    rated = fitted(own, fits, "goals", xs, "poisson", {"_against": [swapped.get(x, F.col(x)) for x in xs]}, out="_for")
    both = fitted(rated, fits, "clean", xs, "logistic", out="_logit")
    against = clip("_against", 0.20, 4.20)
    chance = clip(0.55 * F.exp(-against) + 0.45 * F.col("_logit"), 0.02, 0.80)
    keys = [c for c in sides.columns if c not in xs]
    return both.select(*keys, clip("_for", 0.20, 4.20).alias("expected_for"), against.alias("expected_against"), chance.alias("clean_chance"))


def action_models() -> list[Glm]:
    return [Glm("ridge_a", "_gain", "gaussian", 90.0, 0.88, "_load"), Glm("ridge_b", "_gain", "gaussian", 180.0, 0.78, "_load"),
            Glm("win_a", "_win", "logistic", 1 / 0.08, 0.88, "_load"), Glm("win_b", "_win", "logistic", 1 / 0.035, 0.78, "_load")]


def action_fits(df: DataFrame, xs: Sequence[str], gain: str, epoch: str = "epoch", quantile: float = 0.75, least: int = 250) -> DataFrame:
    """Per later epoch: value and win chance of an action, each the mean of a stronger and a weaker fit, and whether to accept it.

    Gains are held in -35..35 and weigh 1 + .03 * min(|gain|, 20). An action is accepted if its value is positive, its win chance at least
    one half, and the two ridges differ by at most the `quantile` of their difference on the training rows. Adds value, win, gap, limit and
    accepted. Epochs with fewer than `least` earlier rows have no fit and no rows.
    """
    g = clip(F.col(gain).cast("double"), -35.0, 35.0)
    ready = df.withColumnRenamed(epoch, "epoch") if epoch != "epoch" else df
    ready = ready.withColumn("_gain", g).withColumn("_win", (F.col(gain) > 0).cast("double")).withColumn("_load", 1 + 0.03 * F.least(F.abs(g), F.lit(20.0)))
    ready = settle(ready, "actions")
    fits = settle(expanding_glms(ready, xs, action_models(), ready.select("epoch"), least=least), "action-fits")
    pairs = fits.where(F.col("_model").isin("ridge_a", "ridge_b")).groupBy(F.col("epoch").alias("_target")).agg(
        *[F.max(F.when(F.col("_model") == f"ridge_{s}", F.struct("_mean", "_scale", "_b"))).alias(f"_fit_{s}") for s in "ab"])
    seen = ready.select("epoch", *xs).join(pairs, F.col("epoch") < F.col("_target"))  # a difference belongs to a row and a fit
    for s in "ab":
        seen = seen.select("*", *[F.col(f"_fit_{s}.{c}").alias(c) for c in ("_mean", "_scale", "_b")]).withColumn(f"_v{s}", predict(xs, "gaussian")).drop("_mean", "_scale", "_b")
    limit = exact_quantiles(seen.select("_target", F.abs(F.col("_va") - F.col("_vb")).alias("gap")), ["_target"], {"limit": ("gap", quantile)}).withColumnRenamed("_target", "epoch")
    scored = ready.join(limit, "epoch")
    for name, family in (("ridge_a", "gaussian"), ("ridge_b", "gaussian"), ("win_a", "logistic"), ("win_b", "logistic")):
        scored = fitted(scored, fits, name, xs, family, out=f"_{name}")
    value, win, gap = (F.col("_ridge_a") + F.col("_ridge_b")) / 2, (F.col("_win_a") + F.col("_win_b")) / 2, F.abs(F.col("_ridge_a") - F.col("_ridge_b"))
    scored = scored.withColumn("value", value).withColumn("win", win).withColumn("gap", gap).withColumnRenamed("epoch", epoch)
    return scored.select(*df.columns, "value", "win", "gap", "limit").withColumn("accepted", (F.col("value") > 0) & (F.col("win") >= 0.5) & (F.col("gap") <= F.col("limit")))


def action_metrics(scored: DataFrame, gain: str) -> DataFrame:
    """Error, rank agreement and the mean gain of accepted actions against taking none."""
    g = F.col(gain)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("value") - g)).alias("mae"), F.corr("value", g.cast("double")).alias("correlation"),
        F.avg(F.when(F.col("accepted"), g)).alias("accepted_gain"), F.avg(F.when(~F.col("accepted"), g)).alias("rejected_gain"),
        F.avg(F.when(F.col("accepted"), 1.0).otherwise(0.0)).alias("accept_rate"),
    )


def opportunity_value(
    df: DataFrame, xs: Sequence[str], target: str, baseline: str, out: str, share: float = 0.55, low: float = -3.0, high: float = 35.0, alpha: float = 35.0, trees: int = 10,
) -> DataFrame:
    """Earlier-epoch ridge mixed with a small tree model, and the spread of earlier residuals.

    Adds `out` and `scale`: max(4, 1.4826 * median |target - prediction|) over earlier epochs' own predictions.
    """
    whole = df.withColumn("_one", F.lit(1))
    linear = season_ahead_ridge(whole, "_one", xs, [target], F.lit(True), F.lit(True), ["_ridge"], [baseline], alpha=alpha, low=-1e9, high=1e9)
    tree = walk_forward_trees(linear, xs, target, F.lit(True), baseline, "_tree", target, low=-1e9, high=1e9, trees=trees, depth=3)
    tree = settle(tree, "trees")
    first = tree.groupBy().agg(F.min("epoch").alias("_first")).withColumn("_one", F.lit(1))
    mixed = tree.join(F.broadcast(first), "_one").withColumn(
        out, F.when(F.col("epoch") == F.col("_first"), F.col(baseline)).otherwise(clip(share * F.col("_ridge") + (1 - share) * F.col("_tree"), low, high))
    )
    mixed = settle(mixed, "values")
    asks = mixed.select("epoch").distinct().withColumn("q", F.lit(0.5))
    medians = expanding_quantiles(mixed.select("epoch", F.abs(F.col(target) - F.col(out)).alias("_res")), [], "epoch", "_res", asks, "_m").where(F.col("_m").isNotNull())
    scale = medians.select("epoch", F.greatest(F.lit(4.0), 1.4826 * F.col("_m")).alias("scale"))
    joined = mixed.join(scale, "epoch", "left").withColumn("scale", F.coalesce("scale", F.lit(8.0)))
    return joined.select(*df.columns, out, "scale")
