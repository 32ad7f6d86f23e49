"""Causal window features: every frame ends before the row it describes.

Frames count rows of one entity, which holds one row per period, so a partition
is as long as the calendar and no longer. Groups that can be as large as the data
(everything in a period or stratum) go through `scale` or an aggregate and a join.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, col, first_match, shrunk_rate
from .scale import ROWS_PER_SLICE, exact_quantiles, ordinal_rank, percentile_ranks, sliced


def timeline(entity: Sequence[str] | str, order: Sequence[str] | str):
    entity = [entity] if isinstance(entity, str) else list(entity)
    order = [order] if isinstance(order, str) else list(order)
    line = Window.partitionBy(*entity).orderBy(*order)
    line.entity, line.order = entity, order  # for operators that cut the line into stretches
    return line


def before(window, rows: int | None = None):
    """The frame of strictly earlier rows: all of them, or the last `rows`."""
    return window.rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def prior_sum(value, window, rows: int | None = None) -> Column:
    return F.coalesce(F.sum(col(value)).over(before(window, rows)), F.lit(0))


def prior_mean(value, window, rows: int | None = None, at_least: int = 1) -> Column:
    """Mean of the non-null values in the prior frame; null with fewer than `at_least`."""
    frame = before(window, rows)
    return F.when(F.count(col(value)).over(frame) >= at_least, F.avg(col(value)).over(frame))


def prior_std(value, window, rows: int, at_least: int = 2) -> Column:
    """Sample standard deviation over the prior frame."""
    frame = before(window, rows)
    return F.when(F.count(col(value)).over(frame) >= at_least, F.stddev_samp(col(value)).over(frame))


#: Fall of a weight, as a natural logarithm, over which sums are taken in one stretch: e^138 is about 1e60.
STRETCH = 138.0


def attach_prior_ewm(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], window) -> DataFrame:
    """Adds, per name, the exponentially weighted mean (value, alpha) of earlier rows, started at the first observation.

    A missing row still decays the weight of the past: after k steps it is w = (1-alpha)^k, and the mean is taken over that weight plus alpha.
    So an observation x turns the mean y into a y + b with a = w / (w + alpha) and b = alpha x / (w + alpha). Such steps compose: with C the
    running sum of -log a, a line is cut into stretches where C passes multiples of `STRETCH`; inside one the mean is a sum of b e^C, and what an
    earlier stretch left is carried by e^-(difference of C). Values are taken from the line's first one, so equal values keep their mean to the bit. What lies two stretches back weighs less than e^-`STRETCH`, which no double can show.
    `window` is a `timeline`. No list of earlier rows is built, and a row costs the same however long its line.
    """
    line, stretch, out = window, {}, df.select("*", F.row_number().over(window).alias("_row"))
    for i, (value, alpha) in enumerate(wanted.values()):
        out = out.withColumn(f"_x{i}", col(value).cast("double"))
    seen = [F.when(F.col(f"_x{i}").isNotNull(), F.col("_row")).alias(f"_s{i}") for i in range(len(wanted))]
    out = out.select("*", *seen)
    origin = [F.first(f"_x{i}", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_o{i}") for i in range(len(wanted))]
    out = out.select("*", *origin, *[F.last(f"_s{i}", ignorenulls=True).over(before(line)).alias(f"_l{i}") for i in range(len(wanted))])
    steps = []
    for i, (_, alpha) in enumerate(wanted.values()):
        k = F.col("_row") - F.col(f"_l{i}")
        w = F.pow(F.lit(1 - alpha), k)
        first = F.col(f"_l{i}").isNull()
        fall = F.when(first, 0.0).otherwise(F.log(w + alpha) - k * math.log(1 - alpha))
        gain = F.when(first, 0.0).otherwise(alpha * (F.col(f"_x{i}") - F.col(f"_o{i}")) / (w + alpha))
        steps += [F.when(F.col(f"_x{i}").isNotNull(), fall).alias(f"_f{i}"), gain.alias(f"_g{i}")]
    out = out.select("*", *steps)
    out = out.select("*", *[F.sum(f"_f{i}").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_c{i}") for i in range(len(wanted))])
    out = out.select("*", *[F.when(F.col(f"_x{i}").isNotNull(), F.floor(F.col(f"_c{i}") / STRETCH)).alias(f"_p{i}") for i in range(len(wanted))])
    for i in range(len(wanted)):
        part = Window.partitionBy(*line.entity, f"_p{i}").orderBy(*line.order)
        start = F.col(f"_p{i}") * STRETCH
        total = F.sum(F.col(f"_g{i}") * F.exp(F.col(f"_c{i}") - start)).over(part.rowsBetween(Window.unboundedPreceding, 0))
        stretch[i] = Window.partitionBy(*line.entity, f"_p{i}").orderBy(*line.order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_t{i}", F.when(F.col(f"_x{i}").isNotNull(), total * F.exp(start - F.col(f"_c{i}"))))
    left = [F.when(F.col(f"_x{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias("t"), F.col(f"_c{i}").alias("c"), F.col(f"_p{i}").alias("p"))).alias(f"_e{i}") for i in range(len(wanted))]
    out = out.select("*", *left).select("*", *[F.last(f"_e{i}", ignorenulls=True).over(before(line)).alias(f"_b{i}") for i in range(len(wanted))])
    for i in range(len(wanted)):
        carried = F.first(F.when(F.col(f"_b{i}.p") < F.col(f"_p{i}"), F.col(f"_b{i}"))).over(stretch[i])
        mean = F.col(f"_t{i}") + F.coalesce(carried["t"] * F.exp(carried["c"] - F.col(f"_c{i}")), F.lit(0.0))
        out = out.withColumn(f"_y{i}", F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_o{i}") + mean))
    return out.select(*df.columns, *[F.last(f"_y{i}", ignorenulls=True).over(before(line)).alias(name) for i, name in enumerate(wanted)])


def days_since(instant, window, low=2.0, high=14.0, default=7.0) -> Column:
    gap = F.timestamp_diff("MICROSECOND", F.lag(col(instant)).over(window), col(instant))
    return F.coalesce(clip(gap / F.lit(86_400_000_000.0), low, high), F.lit(default))


def forward_label(value: str, period: str, window, horizon: int, gamma: float = 0.86) -> tuple[Column, Column]:
    """Discounted sum over this and the next horizon-1 rows, and the last period it uses."""
    total = col(value).cast("double")
    for k in range(1, horizon):
        total = total + F.lit(gamma**k) * F.coalesce(F.lead(value, k).over(window), F.lit(0))
    return total, F.max(period).over(window.rowsBetween(0, horizon - 1))


def forward_fill(value, window) -> Column:
    return F.last(col(value), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def back_fill(value, window) -> Column:
    """Later value for a leading gap. This reads the future; use it on fixed attributes only."""
    return F.first(col(value), ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))


def attach_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates joined back to the rows: partial sums first, no task per group."""
    grouped = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return df.join(grouped, list(keys), "left")


def attach_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.join(exact_quantiles(df, keys, {out: (value, 0.5)}), list(keys), "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; cut to k per input partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def frontier(
    df: DataFrame, keys: Sequence[str], entity: str, score: str, value: str, probability: str,
    by_score: int = 36, by_value: int = 24, by_both: int = 60, sure: float = 0.58,
) -> DataFrame:
    """Rows ranked high by score or value, or likely to take part and fairly high by score."""
    ids = [*keys, entity]
    scored = top_k(df, keys, [F.col(score).desc(), F.col(entity)], by_both, "_r")
    scored = scored.where((F.col("_r") <= by_score) | (F.col(probability) >= sure)).drop("_r")
    valued = top_k(df, keys, [F.col(value).desc(), F.col(entity)], by_value, "_r").drop("_r")
    # both sides hold at most by_both + by_value rows per group
    return scored.unionByName(valued).dropDuplicates(ids)


def event_numbers(df: DataFrame, epoch: str, period: str) -> DataFrame:
    """Dense event number in the epoch and events remaining, counting the current one."""
    calendar = df.select(epoch, period).distinct()
    w = Window.partitionBy(epoch).orderBy(period)
    whole = Window.partitionBy(epoch)
    numbered = calendar.select(
        epoch, period, F.row_number().over(w).alias("event_number"),
        F.count(F.lit(1)).over(whole).alias("_events"),
    ).withColumn("remaining", F.col("_events") - F.col("event_number") + 1).drop("_events")
    return df.join(numbered, [epoch, period])


def table_position(df: DataFrame, epoch: str, period: str, side: str, points: str, scored: str, lost: str) -> DataFrame:
    """Place in the table before the period: points, difference, scored, then side."""
    w = Window.partitionBy(epoch, side).orderBy(period)
    prior = df.select(
        epoch, period, side, prior_sum(points, w).alias("points_before"),
        prior_sum(scored, w).alias("scored_before"),
        (prior_sum(scored, w) - prior_sum(lost, w)).alias("difference_before"),
    )
    # one row per side: sides are a fixed small set
    order = Window.partitionBy(epoch, period).orderBy(
        F.desc("points_before"), F.desc("difference_before"), F.desc("scored_before"), F.asc(side)
    )
    return prior.withColumn("place", F.row_number().over(order))


def spells(df: DataFrame, entity: str, position: str, qualifies: Column, at_least: int) -> DataFrame:
    """Rows in runs of `at_least` or more consecutive qualifying positions.

    Adds `spell` (the same number throughout a run), `offset` from 0 and `spell_rows`.
    """
    hit = df.where(qualifies)
    number = F.row_number().over(Window.partitionBy(entity).orderBy(position))
    runs = hit.withColumn("spell", F.col(position) - number)
    one = Window.partitionBy(entity, "spell")
    return runs.select(
        "*", (F.row_number().over(one.orderBy(position)) - 1).alias("offset"),
        F.count(F.lit(1)).over(one).alias("spell_rows"),
    ).where(F.col("spell_rows") >= at_least)


def droughts(rows: DataFrame, entity: str, period: str, hurdle: float) -> DataFrame:
    """One row per spell: totals, warnings in order and the first cause that fits.

    `rows` comes from `spells` and has points, forecast, minutes, play, expected_minutes,
    severe, plan_delta, decision_delta, transfer_made, fall_probability, pressure_rank and
    hindsight (deltas null where no replacement exists).
    """
    clears = F.coalesce(F.col("plan_delta") >= hurdle, F.lit(False))
    fading = (F.col("play") < 0.72) | (F.col("expected_minutes") < 52) | F.col("severe")
    leaving = (F.col("fall_probability") >= 0.55) | (F.col("pressure_rank") <= 0.15)
    marks = [(fading, "availability/minutes"), (clears, "model-rated replacement"),
             (leaving, "market exit"), (F.col("offset") >= 2, "known return drought")]
    signals = F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in marks]))
    steady = (F.col("play") >= 0.78) & (F.col("expected_minutes") >= 58)
    mismatch = F.coalesce((F.col("decision_delta") >= hurdle) & (F.col("plan_delta") < hurdle), F.lit(False))
    marked = rows.withColumn("signals", signals)
    warned = F.size("signals") > 0

    def tally(test):
        return F.count(F.when(test, 1)).cast("int")

    spell = marked.groupBy(entity, "spell").agg(
        F.min(period).alias("start"), F.max(period).alias("end"), F.count(F.lit(1)).cast("int").alias("weeks"),
        F.sum("points").cast("double").alias("actual"), F.sum("forecast").alias("projected"),
        tally(F.col("minutes") <= 0).alias("no_shows"), F.avg("play").alias("average_play"),
        tally(clears).alias("_clear"), tally(clears & ~F.col("transfer_made")).alias("_free"),
        tally(fading).alias("_fading"), tally(warned).alias("warnings"),
        tally(mismatch).alias("mismatches"),
        F.min(F.when(F.col("offset") < 2, steady).otherwise(F.lit(True))).alias("_steady"),
        F.sort_array(F.collect_list(F.when(warned, F.struct(F.col(period).alias("period"), "signals")))).alias("timeline"),
        F.coalesce(F.max("hindsight"), F.lit(0.0)).alias("best_hindsight"),
    )
    short = F.col("projected") - F.col("actual")
    cause = first_match(
        [
            (F.col("_free") > 0, "local transfer opportunity conflict"),
            (F.col("_clear") > 0, "transfer prioritised elsewhere"),
            ((F.col("no_shows") >= 2) & (F.col("_fading") > 0), "foreseeable availability decay"),
            (F.col("_steady") & (short >= 6), "rough patch / outcome variance"),
            (F.col("warnings") > 0, "mixed warning"),
        ],
        "unforeseeable or weak evidence",
    )
    return spell.withColumn("shortfall", short).withColumn("classification", cause).drop(
        "spell", "_clear", "_free", "_fading", "_steady"
    )


def availability_flags(trusted: Column, outlook: Column, minutes: Column, slate: Column, pressure: Column, window) -> dict[str, Column]:
    """Zero-outlook, market and composite warnings from this row and the one before."""
    zero = (slate > 0) & F.coalesce(trusted, F.lit(False)) & F.coalesce(outlook <= 0, F.lit(False))
    was_trusted = F.coalesce(F.lag(trusted).over(window), F.lit(False))
    was_zero = F.coalesce(F.lag(outlook).over(window) <= 0, F.lit(False))
    was_out = F.coalesce(F.lag(minutes).over(window), F.lit(0)) <= 0
    market = (slate > 0) & F.coalesce(pressure <= -0.90, F.lit(False)) & F.coalesce(
        F.lag(minutes).over(window) < 60, F.lit(False)
    )
    severe = zero & F.coalesce(pressure <= -0.75, F.lit(False))
    repeat = zero & was_trusted & was_zero & was_out
    return {"zero_signal": zero, "market_warning": market, "severe_warning": severe | repeat | market}


def linspace_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """Position in the group scaled to 0..1 by stable order; a lone row gets 1."""
    ranked = ordinal_rank(df, keys, value, tie, "_rn")
    scaled = F.when(F.col("_rn_of") == 1, F.lit(1.0)).otherwise((F.col("_rn") - 1) / (F.col("_rn_of") - 1))
    return ranked.withColumn(out, scaled).drop("_rn", "_rn_of")


def shrunk_prior_rate(successes, trials, prior: Column, strength: float, window, rows: int, low: float, high: float) -> Column:
    return clip(
        shrunk_rate(prior_sum(successes, window, rows), prior_sum(trials, window, rows), prior, strength), low, high
    )


def matchup_history(
    df: DataFrame, entity: str, opponent: str, venue: str, order: Sequence[str], played: Column,
    points: Column, level: Column, strength: float = 8.0, venue_strength: float = 10.0,
) -> DataFrame:
    """Earlier results by entity, by opponent and by opponent and venue, shrunk to the level."""
    event = F.when(played, F.lit(1)).otherwise(F.lit(0))
    gained = F.when(played, points).otherwise(F.lit(0))
    general = Window.partitionBy(entity).orderBy(*order)
    pair = timeline([entity, opponent], order)
    place = Window.partitionBy(entity, opponent, venue).orderBy(*order)
    n_pair = prior_sum(event, pair)
    shrunk = (prior_sum(gained, pair) + strength * level) / (n_pair + strength)
    recent = F.coalesce(F.col("_recent"), level)
    n_recent = F.least(n_pair, F.lit(4))
    return attach_prior_ewm(df, {"_recent": (F.when(played, points), 0.45)}, pair).select(
        *df.columns,
        prior_sum(event, general).alias("matches"),
        n_pair.alias("pair_matches"),
        shrunk.alias("pair_points"),
        clip(shrunk - level, -1.5, 1.5).alias("pair_uplift"),
        ((n_recent * recent + 6.0 * level) / (n_recent + 6.0)).alias("pair_recent"),
        (1 - F.exp(-n_pair / 3.0)).alias("pair_evidence"),
        ((prior_sum(gained, place) + venue_strength * level) / (prior_sum(event, place) + venue_strength)).alias("venue_points"),
    )


def group_pressure(df: DataFrame, keys: Sequence[str], viable: Column, slots: Column, out: str) -> DataFrame:
    """Viable members beyond the slots, over the slots, in 0..1.5."""
    joined = attach_group(df, keys, _viable=F.count(F.when(viable, 1)))
    return joined.withColumn(out, clip(F.greatest(F.col("_viable") - slots, F.lit(0.0)) / slots, 0.0, 1.5)).drop("_viable")


def lineup_change(lineups: DataFrame, keys: Sequence[str], order: str, members: str) -> DataFrame:
    """Mean change of the last six consecutive line-ups before each one; 0.22 with none."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.lag(members).over(w)
    shared = F.size(F.array_intersect(F.col(members), last))
    slots = F.greatest(F.least(F.size(last), F.size(members), F.lit(11)), F.lit(1))
    changed = lineups.withColumn("_change", F.when(last.isNotNull(), 1 - shared / slots))
    return changed.withColumn(
        "rotation", clip(F.coalesce(prior_mean("_change", w, 6), F.lit(0.22)), 0.0, 0.75)
    ).drop("_change")


def side_ratings(side: DataFrame) -> DataFrame:
    """Attack, defence, form and clean ratings before each period, with regime shifts.

    `side` has epoch, period, side, games, scored, x_scored, lost, x_lost, results, cleans,
    one row per side and period. Newly present sides start near the league rate.
    """
    games = F.greatest(F.col("games"), F.lit(1)).cast("double")

    def observed(real, expected):
        r, e = F.col(real) / games, F.col(expected) / games
        return F.when(F.col(expected) > 0, 0.72 * e + 0.28 * r).otherwise(r)

    league = side.groupBy("epoch", "period").agg(F.sum("scored").alias("_s"), F.sum("games").alias("_g"))
    league = league.withColumn("_rate", F.col("_s") / F.greatest(F.col("_g"), F.lit(1)))
    league = league.select(
        "epoch", "period",
        clip(F.coalesce(prior_mean("_rate", timeline("epoch", "period")), F.lit(1.40)), 0.9, 2.0).alias("league"),
    )
    sides = side.select("epoch", "side").distinct()
    earlier = sides.select((F.col("epoch") + 1).alias("epoch"), "side")
    fresh = sides.where(F.col("epoch") > 0).join(earlier, ["epoch", "side"], "left_anti").withColumn("_fresh", F.lit(1.0))
    base = side.select(
        "epoch", "period", "side", "games", observed("scored", "x_scored").alias("_attack"),
        observed("lost", "x_lost").alias("_defence"), (F.col("results") / games).alias("_form"),
        (F.col("cleans") / games).alias("_clean"),
    ).join(league, ["epoch", "period"]).join(fresh, ["epoch", "side"], "left")
    first_period = Window.partitionBy("epoch")
    base = base.withColumn("_gw", F.col("period") - F.min("period").over(first_period) + 1)
    w = timeline("side", ["epoch", "period"])
    known = prior_sum("games", w)
    means = {"_a": ("_attack", 0.22), "_d": ("_defence", 0.22), "_f": ("_form", 0.22), "_c": ("_clean", 0.22), "_quick_a": ("_attack", 0.48), "_quick_d": ("_defence", 0.48)}
    rated = attach_prior_ewm(base.select("*", clip(known / (known + 8.0), 0.0, 0.94).alias("_conf")), means, w).select(
        "*", F.coalesce("_quick_a", "league").alias("_fast_a"), F.coalesce("_quick_d", "league").alias("_fast_d")
    )

    def settled(name, fallback, low, high):
        return clip(F.col("_conf") * F.coalesce(F.col(name), fallback) + (1 - F.col("_conf")) * fallback, low, high)

    league_rate = F.col("league")
    rated = rated.select(
        "*", settled("_a", league_rate, 0.45, 2.70).alias("_ra"), settled("_d", league_rate, 0.45, 2.70).alias("_rd"),
        settled("_f", F.lit(1.35), 0.0, 3.0).alias("form"), settled("_c", F.lit(0.28), 0.0, 0.75).alias("clean"),
        (F.coalesce(F.col("_fresh"), F.lit(0.0)) * F.exp(-F.greatest(F.col("_gw") - 1, F.lit(0)) / 8.0)).alias("_new"),
    )
    gap = (F.abs(F.col("_fast_a") - F.col("_ra")) + F.abs(F.col("_fast_d") - F.col("_rd"))) / (
        2 * F.greatest(league_rate, F.lit(0.8))
    )
    rated = rated.withColumn("shift", clip(1 - (1 - clip(gap, 0.0, 0.75)) * (1 - 0.62 * F.col("_new")), 0.0, 0.85))
    weight = clip(0.25 + F.col("shift"), 0.25, 0.75)
    shrink = clip(0.42 * F.col("_new"), 0.0, 0.42)

    def moved(slow, fast):
        mixed = clip((1 - weight) * F.col(slow) + weight * F.col(fast), 0.45, 2.70)
        return clip((1 - shrink) * mixed + shrink * league_rate, 0.45, 2.70)

    return rated.select(
        "epoch", "period", "side", "league", moved("_ra", "_fast_a").alias("attack"),
        moved("_rd", "_fast_d").alias("defence"), "form", "clean", "shift",
        clip(F.col("_conf") * (1 - 0.52 * F.col("shift")), 0.0, 0.94).alias("confidence"),
    )


def matchup_rates(league, attack, defence, their_attack, their_defence, home) -> dict[str, Column]:
    """Expected scored, lost and clean-sheet chance from both sides' ratings and the venue."""
    league = clip(F.coalesce(col(league), F.lit(1.40)), 0.9, 2.0)

    def rate(own, other, factor):
        own, other = F.coalesce(col(own), league), F.coalesce(col(other), league)
        return clip(league * F.pow(own / league, 0.70) * F.pow(other / league, 0.70) * factor, 0.30, 3.40)

    at_home = F.coalesce(col(home), F.lit(False))
    scored = rate(attack, their_defence, F.when(at_home, F.lit(1.12)).otherwise(F.lit(0.88)))
    lost = rate(defence, their_attack, F.when(at_home, F.lit(0.88)).otherwise(F.lit(1.12)))
    return {"expected_for": scored, "expected_against": lost, "clean_chance": clip(F.exp(-lost), 0.03, 0.74)}


def utility_mix(df: DataFrame, deadline: Sequence[str], entity: str, mixes: dict[str, dict[str, float]], plain: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Weighted sums of whole-pool percentiles at each deadline, one output per mix; `plain` adds weights of columns as they are to a mix."""
    columns = sorted({c for mix in mixes.values() for c in mix})
    ranked = percentile_ranks(df, deadline, {c: f"_p_{c}" for c in columns}, fill=None, ids=[entity])
    for name, mix in mixes.items():
        total = F.lit(0.0)
        for column, weight in mix.items():
            total = total + weight * F.col(f"_p_{column}")
        for column, weight in (plain or {}).get(name, {}).items():
            total = total + weight * F.col(column)
        ranked = ranked.withColumn(name, total)
    return ranked.drop(*[f"_p_{c}" for c in columns])


def congestion(fixtures: DataFrame, home: str, away: str, kickoff: str, default: float = 7.0, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Smallest gap in days between consecutive kick-offs per side; `default` with one or none.

    A long line of kick-offs is cut into stretches of time. Each gives its first, its last and its least gap, and the gaps between neighbouring
    stretches are added in order, so no task holds the whole line of a side.
    """
    sides = fixtures.select(F.explode(F.array(home, away)).alias("side"), F.col(kickoff).alias("_at"))
    # kick-offs are collapsed first, so a side has one row per instant
    at = sides.groupBy("side", "_at").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_at").isNotNull())
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("_at").cast("timestamp_ntz"))
    cut = sliced(at.withColumn("_micros", since), ["side"], "_micros", rows_per_slice)
    day = F.lit(86_400_000_000.0)
    gap = (F.col("_micros") - F.lag("_micros").over(timeline(["side", "_slice"], "_micros"))) / day
    gaps = cut.select("side", "_slice", "_micros", F.when(F.col("_n") > 1, F.lit(0.0)).otherwise(gap).alias("_gap"))
    parts = gaps.groupBy("side", "_slice").agg(F.min("_micros").alias("_first"), F.max("_micros").alias("_last"), F.min("_gap").alias("_gap"))
    between = (F.col("_first") - F.lag("_last").over(timeline("side", "_slice"))) / day
    joined = parts.select("side", "_gap", between.alias("_between")).groupBy("side").agg(F.least(F.min("_gap"), F.min("_between")).alias("minimum_gap"))
    known = sides.select("side").distinct()
    return known.join(joined, known["side"].eqNullSafe(joined["side"]), "left").select(known["side"], F.coalesce("minimum_gap", F.lit(default)).alias("minimum_gap"))
