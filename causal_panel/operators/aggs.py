"""Roll-ups, error and probability metrics, bins, resampling and policy comparisons."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, col
from .scale import exact_quantiles, ordered_prefix, percentile_ranks
from .windows import top_k


def rate(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def weighted(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def mixed_rollup(
    df: DataFrame, keys: Sequence, order: Column, total=(), mean=(), most=(), first=(), distinct=()
) -> DataFrame:
    """Sum, mean, max, first non-null by order, and distinct count in one pass."""
    aggs = [F.sum(c).alias(f"sum_{c}") for c in total]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in mean]
    aggs += [F.max(c).alias(f"max_{c}") for c in most]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"first_{c}") for c in first]
    aggs += [F.count_distinct(F.col(c)).alias(f"n_{c}") for c in distinct]
    return df.groupBy(*keys).agg(*aggs)


def two_level_rollup(df: DataFrame, outer: Sequence, inner: Sequence, most: Sequence[str], total: Sequence[str]) -> DataFrame:
    """Within the inner group take max (or sum), then add up over the outer group."""
    once = df.groupBy(*outer, *inner).agg(*[F.max(c).alias(c) for c in most], *[F.sum(c).alias(c) for c in total])
    names = [c if isinstance(c, str) else once.columns[i] for i, c in enumerate(outer)]
    return once.groupBy(*names).agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in (*most, *total)])


def feed_quality(df: DataFrame, period: Sequence[str], popular: Column, value: str, least: int = 20, most_zero: float = 0.65) -> DataFrame:
    """Attach `trusted`: enough popular rows in the period and not too many of them at zero."""
    seen = df.where(popular & F.col(value).isNotNull()).groupBy(*period).agg(
        F.count(F.lit(1)).alias("_n"), rate(F.col(value) <= 0).alias("_zero")
    )
    good = seen.where((F.col("_n") >= least) & (F.col("_zero") <= most_zero)).select(*period, F.lit(True).alias("trusted"))
    return df.join(good, list(period), "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def distribution_summary(df: DataFrame, keys: Sequence[str], points: str, minutes: str, good: int = 5) -> DataFrame:
    p = F.col(points)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.sum(p).alias("total"), F.avg(p).alias("average"),
        F.stddev_samp(p).alias("volatility"), rate(p >= good).alias("return_rate"),
        (90 * F.sum(p) / F.greatest(F.sum(minutes), F.lit(1))).alias("per90"),
    )


def segment_metrics(df: DataFrame, forecast: str, actual: str, segments: dict[str, Column]) -> DataFrame:
    """Rows, means, bias, MAE, return and blank rates overall and for every segmentation, in one shuffle."""
    tags = [F.struct(F.lit("overall").alias("segment"), F.lit("all").alias("value"))]
    tags += [F.struct(F.lit(n).alias("segment"), c.cast("string").alias("value")) for n, c in segments.items()]
    f, a = F.col(forecast), F.col(actual)
    tagged = df.select(f, a, F.explode(F.array(*tags)).alias("_t")).where(F.col("_t.value").isNotNull())
    return tagged.groupBy(F.col("_t.segment").alias("segment"), F.col("_t.value").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(f).alias("forecast"), F.avg(a).alias("actual"), F.avg(f - a).alias("bias"),
        F.avg(F.abs(f - a)).alias("mae"), rate(a >= 5).alias("return_rate"), rate(a <= 2).alias("blank_rate"),
    )


def cut(value, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: label i holds edges[i] < x <= edges[i+1]; outside gives null."""
    x = col(value)
    out = F.when(x <= edges[0], F.lit(None))
    for upper, label in zip(edges[1:], labels):
        out = out.when(x <= upper, F.lit(label))
    return out


def quantile_bins(df: DataFrame, value: str, parts: int, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins 0..: interpolated edges, right-closed, lowest included, equal edges merged."""
    keys = list(keys)
    wanted = {f"_q{i}": (value, i / parts) for i in range(parts + 1)}
    edges = exact_quantiles(df, keys, wanted).select(
        *keys, F.array_sort(F.array_distinct(F.array(*wanted))).alias("_edges")
    )
    if keys:
        joined = df.join(edges, keys, "left")
    else:
        # a single row of parts + 1 edges
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one").drop("_one")
    inner = F.slice(F.col("_edges"), F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("_edges")


def poisson_deviance(actual, predicted) -> Column:
    """Mean deviance; an actual of zero adds no log term and predictions stay at or above .02."""
    a, p = col(actual).cast("double"), F.greatest(col(predicted).cast("double"), F.lit(0.02))
    term = F.when(a > 0, a * F.log(a / p)).otherwise(F.lit(0.0))
    return F.avg(2.0 * (term - (a - p)))


def brier(probability, outcome) -> Column:
    gap = col(probability) - col(outcome)
    return F.avg(gap * gap)


def weighted_probability_metrics(df: DataFrame, keys: Sequence, probability: str, outcome: Column, weight: str) -> DataFrame:
    error, w = F.col(probability) - outcome, F.col(weight)
    return df.where(w > 0).groupBy(*keys).agg(
        weighted(error * error, w).alias("brier"), weighted(F.abs(error), w).alias("mae"), weighted(error, w).alias("bias")
    )


def tenth(probability) -> Column:
    """Bin 0..9 of a probability."""
    return F.least(F.floor(col(probability) * 10), F.lit(9)).cast("int")


def reliability(df: DataFrame, probability: str, outcome: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, tenth(probability).alias("bin")).agg(
        F.avg(probability).alias("forecast"), F.avg(outcome).alias("observed"), F.count(F.lit(1)).alias("rows")
    )


def interval_coverage(df: DataFrame, residual: Column, lower: Column, upper: Column) -> DataFrame:
    return df.agg(
        rate((residual >= lower) & (residual <= upper)).alias("coverage"),
        rate(residual >= lower).alias("lower_coverage"), rate(residual <= upper).alias("upper_coverage"),
    )


def sigma_bins(df: DataFrame, sigma: str, residual: str, parts: int = 5) -> DataFrame:
    """Predicted against realised spread by quantile bin of the predicted sigma."""
    r = F.col(residual)
    return quantile_bins(df, sigma, parts, "bin").groupBy("bin").agg(
        F.avg(sigma).alias("predicted"), F.stddev_pop(r).alias("realised"), F.avg(F.abs(r)).alias("mae"), F.count(F.lit(1)).alias("rows")
    )


def group_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 20) -> DataFrame:
    """Rank correlation per group with average ties; small and undefined groups are left out."""
    ranked = percentile_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, {x: "_rx", y: "_ry"}, fill=None)
    per_group = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.corr("_rx", "_ry").alias("spearman"))
    return per_group.where((F.col("rows") >= least) & F.col("spearman").isNotNull() & ~F.isnan("spearman"))


def weighted_correlation(x: str, y: str, weight: Column) -> Column:
    w, a, b = weight, F.col(x), F.col(y)
    n = F.sum(w)
    cov = F.sum(w * a * b) / n - F.sum(w * a) / n * (F.sum(w * b) / n)
    va = F.sum(w * a * a) / n - F.pow(F.sum(w * a) / n, 2)
    vb = F.sum(w * b * b) / n - F.pow(F.sum(w * b) / n, 2)
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def top_quality(df: DataFrame, keys: Sequence[str], forecast: str, actual: str, tie: str, k: int = 15) -> DataFrame:
    """Mean and blank rate of the k highest forecasts per group, and the share of hauls they miss."""
    chosen = top_k(df, keys, [F.desc(forecast), F.asc(tie)], k, "_r").groupBy(*keys).agg(
        F.avg(actual).alias("top_points"), rate(F.col(actual) <= 2).alias("top_blank_rate"),
        F.count(F.when(F.col(actual) >= 8, 1)).alias("_caught"),
    )
    hauls = df.groupBy(*keys).agg(F.count(F.when(F.col(actual) >= 8, 1)).alias("_hauls"), F.count(F.lit(1)).alias("rows"))
    missed = F.when(F.col("_hauls") > 0, (F.col("_hauls") - F.col("_caught")) / F.col("_hauls")).otherwise(F.lit(0.0))
    return hauls.join(chosen, list(keys)).select(*keys, "rows", "top_points", "top_blank_rate", missed.alias("missed_rate"))


def cap_regret(df: DataFrame, keys: Sequence[str], entity: str, price: str, forecast: str, actual: str, step: int = 10, least: int = 5) -> DataFrame:
    """For each price cap: best actual less the actual of the best forecast, for one and for three.

    Each (group, step of price) is first cut to its three best by either measure: no other row can be
    chosen at any cap. The caps then work on those few rows and on counts.
    """
    keys = list(keys)
    band = (F.ceil(F.col(price) / step) * step).cast("int")
    rows = df.select(*keys, entity, F.col(price).alias("_p"), band.alias("_b"), F.col(forecast).alias("_f"), F.col(actual).alias("_a"))
    span = rows.groupBy(*keys).agg(
        (F.ceil(F.min("_p") / step) * step).cast("int").alias("_lo"), (F.floor(F.max("_p") / step) * step).cast("int").alias("_hi")
    ).where(F.col("_lo") <= F.col("_hi"))
    cells = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))

    def capped(df_):
        caps = F.sequence(F.greatest("_b", "_lo"), F.col("_hi"), F.lit(step))
        return df_.join(span, keys).where(F.greatest("_b", "_lo") <= F.col("_hi")).withColumn("cap", F.explode(caps))

    enough = capped(cells).groupBy(*keys, "cap").agg(F.sum("_n").alias("affordable")).where(F.col("affordable") >= least)

    def best(measure, tag):
        few = top_k(rows, [*keys, "_b"], [F.desc(measure), F.asc(entity)], 3, "_r").drop("_r")
        three = top_k(capped(few), [*keys, "cap"], [F.desc(measure), F.asc(entity)], 3, "_r")
        return three.groupBy(*keys, "cap").agg(
            F.max(F.when(F.col("_r") == 1, F.col("_a"))).alias(f"{tag}1"), F.sum("_a").alias(f"{tag}3")
        )

    joined = enough.join(best("_f", "f"), [*keys, "cap"]).join(best("_a", "a"), [*keys, "cap"])
    return joined.select(
        *keys, "cap", "affordable", (F.col("a1") - F.col("f1")).cast("double").alias("regret"),
        (F.col("a3") - F.col("f3")).cast("double").alias("regret3"),
    )


def local_anchors(pairs: DataFrame, points: str, rank: str, target: int, nearest: int = 120) -> DataFrame:
    """The nearest distinct (points, rank) pairs to a target rank by log distance, numbered from 0."""
    log_rank = F.log(F.col(rank).cast("double"))
    far = F.abs(log_rank - F.log(F.lit(float(target))))
    few = pairs.select(F.col(points).cast("double").alias("points"), F.col(rank).alias("rank")).distinct()
    few = few.withColumn("_d", F.abs(F.log(F.col("rank").cast("double")) - F.log(F.lit(float(target))))).orderBy("_d", "points", "rank").limit(nearest)
    number = F.row_number().over(Window.orderBy("_d", "points", "rank")) - 1  # at most `nearest` rows
    return few.select("points", "rank", F.log(F.col("rank").cast("double")).alias("log_rank"), number.alias("i"))


def rank_fit(anchors: DataFrame, target: int) -> DataFrame:
    """Log-linear fit over anchors: slope, intercept, fit quality, implied cut-off and observed edge."""
    goal = F.log(F.lit(float(target)))
    fit = anchors.agg(
        F.regr_slope("log_rank", "points").alias("slope"), F.regr_intercept("log_rank", "points").alias("intercept"),
        F.regr_r2("log_rank", "points").alias("r2"), F.count(F.lit(1)).alias("anchors"),
        F.max(F.when(F.col("rank") > target, F.col("points"))).alias("below"),
        F.min(F.when(F.col("rank") <= target, F.col("points"))).alias("above"),
    )
    cutoff = (goal - F.col("intercept")) / F.col("slope")
    return fit.select(
        "slope", "intercept", "r2", "anchors", cutoff.alias("cutoff"), F.coalesce("below", F.floor(cutoff)).alias("observed_lower"),
        F.coalesce("above", F.ceil(cutoff)).alias("observed_upper"),
        F.greatest(F.round(cutoff), F.coalesce("above", F.ceil(cutoff))).alias("target_points"),
    )


def scramble(seed: int, *parts: Column) -> Column:
    """A whole number below 2^31 - 1 from whole numbers, by repeated modular multiplication."""
    modulus = (1 << 31) - 1
    state = F.lit(seed).cast("bigint")
    for part in parts:
        state = F.pmod((state + part.cast("bigint") + 1) * F.lit(48271).cast("bigint"), F.lit(modulus).cast("bigint"))
        state = F.pmod((state + 12345) * F.lit(39373).cast("bigint"), F.lit(modulus).cast("bigint"))
    return state


def bootstrap_cutoff(anchors: DataFrame, target: int, resamples: int = 1200, seed: int = 7) -> DataFrame:
    """Cut-off refitted on resampled anchors (with replacement); keeps falling fits; 5 and 95 %.

    anchors come from `local_anchors`: numbered and few.
    """
    size = anchors.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    slots = anchors.select("i", F.lit(1).alias("_k")).join(F.broadcast(size), "_k").select(
        "i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("rep")
    )
    drawn = slots.select("rep", F.pmod(scramble(seed, F.col("rep"), F.col("i")), F.col("n")).cast("int").alias("i"))
    fits = drawn.join(F.broadcast(anchors), "i").groupBy("rep").agg(
        F.regr_slope("log_rank", "points").alias("slope"), F.regr_intercept("log_rank", "points").alias("intercept")
    ).where(F.col("slope") < -1e-5)
    cutoffs = fits.select(((F.log(F.lit(float(target))) - F.col("intercept")) / F.col("slope")).alias("cutoff"))
    # at most `resamples` rows
    return cutoffs.agg(
        F.count(F.lit(1)).alias("valid"), F.percentile("cutoff", F.lit(0.05)).alias("lower"), F.percentile("cutoff", F.lit(0.95)).alias("upper")
    )


def block_bootstrap(totals: DataFrame, policy: str, order: str, value: str, low: int, high: int, samples: int = 4000, block: int = 4, seed: int = 11) -> DataFrame:
    """Probability that a season rebuilt from blocks of consecutive periods reaches a random cut-off.

    totals: one row per policy and period.
    """
    numbered = totals.select(policy, (F.row_number().over(Window.partitionBy(policy).orderBy(order)) - 1).alias("i"), F.col(value).alias("_v"))
    size = numbered.groupBy(policy).agg(F.count(F.lit(1)).cast("int").alias("n"))
    sample = size.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    length = F.least(F.lit(block), F.col("n"))
    starts = F.greatest(F.col("n") - length + 1, F.lit(1))
    slots = sample.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.pmod(scramble(seed, F.col("s"), F.floor(F.col("j") / length)), starts)
    drawn = slots.select(policy, "s", (start + F.pmod(F.col("j"), length)).cast("int").alias("i"))
    replay = drawn.join(numbered, [policy, "i"]).groupBy(policy, "s").agg(F.sum("_v").alias("total"))
    bar = F.lit(low) + F.pmod(scramble(seed + 1, F.col("s")), F.lit(high - low + 1))
    return replay.groupBy(policy).agg(rate(F.col("total") >= bar).alias("probability"), F.avg("total").alias("mean_total"))


# Gate of a paired action.
ACTION_GATE = {"win": 0.57, "mean": 0.25, "cvar": -4.0, "z": 0.75, "disagreement": 0.35, "credit": 1.5}


def paired_actions(draws: DataFrame, action: str, delta: str, extras: Sequence[str] = (), gate: dict = ACTION_GATE) -> DataFrame:
    """Advantage of each action over holding, from paired draws, with tail mean, utility and gate.

    draws: (action, delta = action - hold - cost + continuation). Optional columns `disagreement`
    and `gain` (constant per action) enter the utility.
    """
    d = F.col(delta)
    edges = exact_quantiles(draws, [action], {"q10": (delta, 0.10), "median": (delta, 0.50)})
    main = draws.groupBy(action).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), rate(d > 0).alias("win"), F.stddev_samp(d).alias("_sd"),
        *[F.max(e).alias(f"_{e}") for e in extras],
    )
    tail = draws.join(edges.select(action, "q10"), action).where(d <= F.col("q10")).groupBy(action).agg(F.avg(d).alias("cvar"))
    joined = main.join(edges, action).join(tail, action)
    se = F.col("_sd") / F.sqrt(F.col("n"))
    lower = F.col("mean") - gate["z"] * se
    utility = lower
    if "disagreement" in extras:
        utility = utility - gate["disagreement"] * F.greatest(F.col("_disagreement"), F.lit(0.0))
    if "gain" in extras:
        utility = utility + gate["credit"] * F.greatest(F.col("_gain"), F.lit(0.0))
    passes = (F.col("mean") >= gate["mean"]) & (F.col("win") >= gate["win"]) & (F.col("cvar") >= gate["cvar"]) & (utility > 0)
    return joined.select(
        action, "mean", "median", "win", "q10", "cvar", se.alias("se"), lower.alias("lower"), utility.alias("utility"),
        F.coalesce(passes, F.lit(False)).alias("passes"),
    )


def choose_action(evaluated: DataFrame, action: str, keys: Sequence[str] = ()) -> DataFrame:
    """The passing action of highest utility, then mean, else 'Hold'."""
    order = F.when(F.col("passes"), F.struct("utility", "mean"))
    return evaluated.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.col(action).cast("string"), order), F.lit("Hold")).alias("chosen"), F.count(F.lit(1)).alias("actions")
    )


def doubly_robust(df: DataFrame, reward, propensity, target, q_logged, q_target) -> DataFrame:
    """Policy value and standard error; impossible propensities and targets fail the job."""
    p, t = col(propensity), col(target)
    checked_p = F.when((p > 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("propensity outside (0, 1]")).cast("double"))
    checked_t = F.when((t >= 0) & (t <= 1), t).otherwise(F.raise_error(F.lit("target probability outside [0, 1]")).cast("double"))
    influence = col(q_target) + checked_t / checked_p * (col(reward) - col(q_logged))
    scored = df.select(influence.alias("_i"))
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("rows"), F.avg("_i").alias("value"),
        F.when(n > 1, F.stddev_samp("_i") / F.sqrt(n)).otherwise(F.lit(0.0)).alias("standard_error"),
    )


# Columns a log needs for off-policy evaluation.
SUPPORT_COLUMNS = ("action", "reward", "behaviour_propensity", "target_probability", "q_logged", "q_target")


def support_audit(log: DataFrame, policy: str, required: Sequence[str] = SUPPORT_COLUMNS) -> DataFrame:
    """Rows, policies present and required columns the log lacks."""
    missing = sorted(set(required) - set(log.columns))
    return log.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(policy).alias("policies"),
    ).select("rows", "policies", F.lit(",".join(missing)).alias("missing"), F.lit(not missing).alias("identified"))


def epoch_summary(totals: DataFrame, policy: str, epoch: str, value: str, baseline: str | None = None, training: int = 2, holdout: int = 2, penalty: float = 0.20) -> DataFrame:
    """Mean, minimum, development and hold-out means per policy after the training epochs.

    With a baseline policy also paired deltas: mean, development stability, worst, and signs.
    totals: one row per policy and epoch.
    """
    order = Window.partitionBy(policy).orderBy(epoch)
    numbered = totals.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(policy)))
    used = numbered.where(F.col("_i") > training)
    dev = F.col("_i") <= F.col("_n") - holdout
    v = F.col(value).cast("double")
    aggs = [F.avg(v).alias("average"), F.min(v).alias("minimum"), F.avg(F.when(dev, v)).alias("development"), F.avg(F.when(~dev, v)).alias("holdout")]
    if baseline is not None:
        base = totals.where(F.col(policy) == baseline).select(epoch, F.col(value).alias("_base"))
        used = used.join(base, epoch, "left").withColumn("_d", v - F.col("_base"))
        d = F.col("_d")
        mean_dev = F.avg(F.when(dev, d))
        aggs += [
            F.avg(d).alias("delta"), mean_dev.alias("development_delta"),
            (mean_dev - penalty * F.stddev_pop(F.when(dev, d))).alias("stability"), F.avg(F.when(~dev, d)).alias("holdout_delta"),
            F.min(d).alias("worst"), F.count(F.when(d > 0, 1)).alias("positive"), F.count(F.when(d < 0, 1)).alias("negative"),
        ]
    return used.groupBy(policy).agg(*aggs)


def integrity_mismatches(df: DataFrame, keys: Sequence[str], side: str, slate: str, scheduled: str) -> DataFrame:
    """Side-periods whose members' slates differ from each other or from the schedule."""
    by_side = df.groupBy(*keys, side).agg(F.min(slate).alias("least"), F.max(slate).alias("most"), F.max(scheduled).alias("planned"))
    return by_side.where((F.col("least") != F.col("planned")) | (F.col("most") != F.col("planned")))


def mass_blanks(df: DataFrame, keys: Sequence[str], side: str, slate: str, scheduled: str, share: float = 0.40, few: int = 12) -> DataFrame:
    """Periods where many have no slate; explained when few sides were active."""
    blank = df.groupBy(*keys).agg(F.count(F.when(F.col(slate) <= 0, 1)).alias("blank"), F.count(F.lit(1)).alias("registered"))
    active = df.where(F.col(scheduled) > 0).groupBy(*keys).agg(F.count_distinct(side).alias("active"))
    joined = blank.join(active, list(keys), "left").withColumn("active", F.coalesce("active", F.lit(0)))
    portion = F.col("blank") / F.col("registered")
    return joined.where(portion >= share).select(*keys, "active", "blank", "registered", portion.alias("share"), (F.col("active") <= few).alias("explained"))


def cause_shares(df: DataFrame, cause: str, error: Column, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Each cause's share of the weighted absolute error, and its weighted bias."""
    parts = df.groupBy(*keys, cause).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"), F.sum(F.abs(error) * weight).alias("_abs"), F.sum(error * weight).alias("_signed")
    )
    whole = F.sum("_abs").over(Window.partitionBy(*keys))  # one row per cause
    return parts.select(
        *keys, cause, "rows", "weight", (F.col("_abs") / F.greatest(whole, F.lit(1e-9))).alias("share"),
        (F.col("_signed") / F.greatest(F.col("weight"), F.lit(1e-9))).alias("bias"),
    )


def covariance_screen(df: DataFrame, epoch: str, features: Sequence[str], target: str, candidates: DataFrame) -> DataFrame:
    """Correlation of each candidate's weighted feature sum with the target, per epoch.

    One pass takes the feature covariances; candidates (name, weights array), however many, then need only those: a row of sums per epoch
    travels to them.
    """
    moments = [F.covar_pop(a, b) for i, a in enumerate(features) for b in features[i:]]
    stats = df.groupBy(epoch).agg(
        F.array(*moments).alias("_s"), F.array(*[F.covar_pop(f, target) for f in features]).alias("_c"), F.var_pop(target).alias("_v"),
    )
    paired = candidates.join(F.broadcast(stats))  # a row per epoch, whatever the data; every epoch screens every candidate
    dot = sum((F.col("weights")[i] * F.col("_c")[i] for i in range(len(features))), F.lit(0.0))
    quad, at = F.lit(0.0), 0
    for i in range(len(features)):
        for k in range(i, len(features)):
            quad = quad + (1.0 if i == k else 2.0) * F.col("weights")[i] * F.col("weights")[k] * F.col("_s")[at]
            at += 1
    spread = quad * F.col("_v")
    return paired.select(epoch, "name", F.when(spread > 0, dot / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("score"))


def scoreboard(scores: DataFrame, manager: str, period: str, points: str, order: Column) -> DataFrame:
    """One score per manager and period (the first by order) and the running total."""
    once = scores.groupBy(manager, period).agg(F.min_by(points, order).alias(points), (F.count(F.lit(1)) - 1).alias("rejected"))
    w = Window.partitionBy(manager).orderBy(period)
    return once.withColumn("cumulative", F.sum(points).over(w))


def new_scores(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not already scored."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def margin_to_benchmark(totals: DataFrame, benchmark: DataFrame, epoch: str, points: str, rank: int = 500_000, near: int = 50) -> DataFrame:
    """Margin to the cut-off, hit, local rank estimate (only near it) and band.

    benchmark: (epoch, target, log_slope).
    """
    joined = totals.join(benchmark, epoch)
    margin = F.col(points) - F.col("target")
    local = F.abs(margin) <= near
    estimate = F.when(local, F.greatest(F.lit(1), F.round(rank * F.exp(F.col("log_slope") * margin)).cast("bigint")))
    band = F.when(margin >= 0, "above").when(margin >= -near, "near").otherwise("below")
    return joined.select(*totals.columns, margin.alias("margin"), (margin >= 0).alias("hit"), estimate.alias("estimated_rank"), band.alias("band"))


def robust_scale(df: DataFrame, keys: Sequence[str], residual: Column, floor: float = 4.0) -> DataFrame:
    """max(floor, 1.4826 * median absolute residual)."""
    sized = df.select(*keys, F.abs(residual).alias("_r"))
    return exact_quantiles(sized, keys, {"_m": ("_r", 0.5)}).select(*keys, F.greatest(F.lit(floor), 1.4826 * F.col("_m")).alias("scale"))


def fixture_peers(df: DataFrame, fixture: Sequence[str], entity: str, score: str, popularity: str) -> DataFrame:
    """Rank among the fixture's members (1 + number with a higher score) and the most popular other."""
    fixture = list(fixture)
    flipped = df.withColumn("_neg", -F.col(score))
    place = ordered_prefix(flipped, fixture, "_neg").select(*fixture, "_neg", (F.col("n_before") + 1).alias("fixture_rank"))
    top = top_k(df, fixture, [F.desc(popularity), F.asc(entity)], 2, "_r").groupBy(*fixture).agg(
        F.max(F.when(F.col("_r") == 1, F.col(entity))).alias("_first"), F.max(F.when(F.col("_r") == 2, F.col(entity))).alias("_second")
    )
    rival = F.coalesce(F.when(F.col("_first") == F.col(entity), F.col("_second")).otherwise(F.col("_first")), F.col(entity))
    return flipped.join(place, [*fixture, "_neg"]).join(top, fixture).withColumn("rival", rival).drop("_neg", "_first", "_second")


def leaderboard(scores: DataFrame, name: str, score: str, best: int = 5) -> DataFrame:
    return scores.orderBy(F.desc(score), F.asc(name)).limit(best)


def score_curve(scores: DataFrame, score: str, points: int = 16) -> DataFrame:
    """Evenly spaced order statistics of the scores: position floor(k * (n-1) / (points-1))."""
    prefix = ordered_prefix(scores, [], score)
    last = F.col("n_total") - 1

    def first_from(position):  # the first k whose position floor(k * last / (points - 1)) is `position` or more
        return F.when(last > 0, F.ceil(position * (points - 1) / F.when(last > 0, last))).otherwise(F.when(position > 0, points).otherwise(0))

    low, high = first_from(F.col("n_before")), F.least(first_from(F.col("n_before") + F.col("n")), F.lit(points)) - 1
    hit = prefix.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).where(F.col("_low") <= F.col("_high"))
    return hit.select(F.explode(F.sequence("_low", "_high")).alias("k"), F.col(score).alias("score"))
