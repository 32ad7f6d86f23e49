"""Points routes, exposure mixtures, reliability and value as Column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clip, col, first_match, floor_poisson_moments, last_match, lookup

# Points per goal and per clean sheet by position.
GOAL_POINTS = {1: 6.0, 2: 6.0, 3: 5.0, 4: 4.0}
CLEAN_POINTS = {1: 4.0, 2: 4.0, 3: 1.0, 4: 0.0}
# Statuses that can rule an entity out, and the horizon knots in periods.
OUT_STATUSES = ("i", "s", "u")
KNOTS = (1.0, 3.0, 6.0, 10.0)
DISCOUNT = 0.86


def minutes_mixture(play, start, sixty) -> dict[str, Column]:
    """Four-way exposure mass with sixty <= start <= play, and its entropy over ln 4."""
    play = clip(col(play), 0.0, 1.0)
    start = F.least(clip(col(start), 0.0, 1.0), play)
    sixty = F.least(clip(col(sixty), 0.0, 1.0), start)
    parts = {"no_show": 1 - play, "cameo": play - start, "start_under": start - sixty, "sixty_plus": sixty}
    entropy = sum((-(p * F.log(clip(p, 1e-12, 1.0))) for p in parts.values()), F.lit(0.0))
    return {**parts, "entropy": clip(entropy / F.log(F.lit(4.0)), 0.0, 1.0)}


def durability(c: dict) -> Column:
    """Chance that a holding stays useful, 0.12..0.96, from deadline-known columns."""
    evidence_depth = 1 - F.exp(-col(c["observations"]) / 16.0)
    confidence = clip(col(c["minutes_confidence"]) / 0.64, 0.0, 1.0)
    availability = (
        0.38 * col(c["play"]) + 0.24 * col(c["start"]) + 0.18 * col(c["sixty"]) + 0.20 * (1 - col(c["volatility"]))
    )
    evidence = 0.40 * confidence + 0.30 * evidence_depth + 0.30 * col(c["side_confidence"])
    return clip(0.78 * availability + 0.22 * evidence - 0.12 * col(c["shift"]), 0.12, 0.96)


def tenure(stable) -> Column:
    return clip(2.0 + 8.0 * col(stable), 2.0, 10.0)


def exit_cost(raw_tenure, remaining, scale: float) -> Column:
    """Cost of a short holding; nil at six periods and when no replacement is expected."""
    needed = F.when(col(remaining) > col(raw_tenure), F.lit(1.0)).otherwise(F.lit(0.0))
    return scale * clip((6.0 - col(raw_tenure)) / 4.0, 0.0, 1.0) * needed


def regime_probability(recent, long, recent_exposure, long_exposure, shift, role_changed, observations) -> Column:
    """Logistic signal of a changed rate or exposure, weighted by sample size."""
    sample = col(observations) / (col(observations) + 8.0)
    rate = clip((col(recent) - col(long)) / F.greatest(F.abs(col(long)), F.lit(0.35)), -2.5, 2.5)
    exposure = clip((col(recent_exposure) - col(long_exposure)) / 30.0, -2.0, 2.0)
    z = -1.65 + sample * (0.90 * rate + 0.65 * exposure) + 0.85 * clip(col(shift), 0.0, 1.0)
    z = z + F.when(col(role_changed), F.lit(0.90)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def fraction(value, default) -> Column:
    """A number as a probability: above one means percent, bad or missing gives `default`."""
    number = col(value).cast("string").try_cast("double")
    scaled = F.when(number > 1, number / 100.0).otherwise(number)
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(number.isNull(), default).otherwise(clip(scaled, 0.0, 1.0))


def first_path(*values) -> Column:
    """The first value present along a chain of nested paths."""
    return F.coalesce(*[col(v).cast("string") for v in values])


def hard_unavailable(slate, status, chance) -> Column:
    """No slate, or an out status with a known chance of zero; an unknown chance is not out."""
    status = F.lower(F.coalesce(col(status), F.lit("a")))
    out = status.isin(*OUT_STATUSES) & F.coalesce(col(chance) <= 0, F.lit(False))
    return (F.coalesce(col(slate), F.lit(0)) <= 0) | out


def resale(current, purchase) -> Column:
    """Sale value in integer tenths: half of a rise, rounded down; a fall is taken in full."""
    current, purchase = col(current).cast("int"), col(purchase).cast("int")
    half = F.floor((current - purchase) / 2).cast("int")
    return F.when(current <= purchase, current).otherwise(purchase + half)


def points_routes(c: dict) -> dict[str, Column]:
    """Realised points by route; `other` is what the named routes leave over."""
    position = col(c["position"])
    back = position.isin(1, 2)
    appearance = (col(c["appearances"]) + col(c["sixties"])).cast("double")
    attack = col(c["goals"]) * lookup(position, GOAL_POINTS) + 3 * col(c["assists"])
    defence = (
        col(c["clean"]) * lookup(position, CLEAN_POINTS)
        + F.when(position == 1, F.floor(col(c["saves"]) / 3)).otherwise(0)
        - F.when(back, F.floor(col(c["conceded"]) / 2)).otherwise(0)
    )
    bonus = col(c["bonus"]).cast("double")
    routes = {"appearance": appearance, "attack": attack, "defence": defence, "bonus": bonus}
    return {**routes, "other": col(c["points"]) - appearance - attack - defence - bonus}


def forecast_routes(c: dict) -> dict[str, Column]:
    """Split a forecast into appearance, attack, clean and bonus routes plus the residual.

    `goal_median` and `assist_median` are the group medians of the vulnerability columns.
    """
    position = col(c["position"])
    slate = F.greatest(col(c["slate"]), F.lit(1)).cast("double")
    exposure = col(c["minutes"]) / 90.0
    level = 0.72 + 0.56 * F.coalesce(col(c["slate_rank"]), F.lit(0.5))
    goal_side = clip(col(c["goal_vulnerability"]) / F.greatest(col(c["goal_median"]), F.lit(0.01)), 0.68, 1.42)
    assist_side = clip(col(c["assist_vulnerability"]) / F.greatest(col(c["assist_median"]), F.lit(0.01)), 0.72, 1.35)
    appearance = (col(c["play"]) + col(c["sixty"])) * slate
    attack = (
        (col(c["goal_rate"]) * lookup(position, GOAL_POINTS) * goal_side + 3.0 * col(c["assist_rate"]) * assist_side)
        * exposure * level * slate
    )
    blended = clip(0.82 * col(c["side_clean"]) + 0.18 * col(c["clean_rate"]), 0.03, 0.78)
    clean = blended * lookup(position, CLEAN_POINTS) * col(c["sixty"]) * slate
    bonus = col(c["bonus_rate"]) * exposure * level * slate
    residual = col(c["forecast"]) - (appearance + attack + clean + bonus)
    return {"appearance": appearance, "attack": attack, "clean": clean, "bonus": bonus, "residual": residual}


def route_distribution(c: dict) -> tuple[Column, Column]:
    """Mean and variance of points from the mean count of each component."""
    position = col(c["position"])
    goal, clean = lookup(position, GOAL_POINTS), lookup(position, CLEAN_POINTS)
    keeper = F.when(position == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    back = F.when(position.isin(1, 2), F.lit(1.0)).otherwise(F.lit(0.0))
    save_mean, save_var = floor_poisson_moments(c["saves"], 3)
    lost_mean, lost_var = floor_poisson_moments(c["conceded"], 2)
    base = col(c["appearance"]) + col(c["sixty"])
    tail = col(c["bonus"]) + col(c["actions"])
    mean = (
        base + goal * col(c["goals"]) + 3 * col(c["assists"]) + clean * col(c["clean"])
        + keeper * save_mean - back * lost_mean + tail + col(c["other"])
    )
    variance = (
        base + goal * goal * col(c["goals"]) + 9 * col(c["assists"]) + clean * clean * col(c["clean"])
        + keeper * save_var + back * lost_var + tail + col(c["other_variance"])
    )
    return mean, F.greatest(variance, F.lit(0.16))


def limited_adjustment(c: dict, strength: float = 1.0, low: float = 0.60, high: float = 1.55) -> Column:
    """Move a score only through its attack, clean and conceded routes, and only where covered."""
    slate = F.greatest(col(c["slate"]), F.lit(1)).cast("double")
    back = F.when(col(c["position"]).isin(1, 2), F.lit(1.0)).otherwise(F.lit(0.0))
    ratio = clip(col(c["new_for"]) / F.greatest(col(c["old_for"]), F.lit(0.25)), low, high)
    attack = col(c["attack"]) * (ratio - 1.0)
    clean = (
        0.82 * (col(c["new_clean"]) - col(c["old_clean"])) * lookup(col(c["position"]), CLEAN_POINTS)
        * col(c["sixty"]) * slate
    )
    conceded = -0.5 * (col(c["new_against"]) - col(c["old_against"])) * (col(c["minutes"]) / 90.0) * back
    delta = F.when(col(c["covered"]), attack + clean + conceded).otherwise(F.lit(0.0))
    return F.when(col(c["slate"]) == 0, F.lit(0.0)).otherwise(col(c["score"]) + strength * delta)


def reliability_penalty(score, slate, new: dict, old_play, old_sixty, strength: float) -> Column:
    """Scale a score down on new downside evidence only; uncertain mixtures lose more."""
    fresh = 0.45 * (1.0 - new["no_show"]) + 0.55 * new["sixty_plus"]
    known = 0.45 * clip(col(old_play), 0.0, 1.0) + 0.55 * clip(col(old_sixty), 0.0, 1.0)
    downside = F.least(fresh - known, F.lit(0.0))
    factor = clip(1.0 + strength * downside * (0.75 + 0.25 * new["entropy"]), 0.55, 1.0)
    return F.when(col(slate) == 0, F.lit(0.0)).otherwise(col(score) * factor)


def availability_overlay(chance, previous_chance, probability, minutes, projected) -> dict[str, Column]:
    """Rescale probability, minutes and projection by the change in chance (ratio 0..1.25)."""
    ratio = clip(col(chance) / F.greatest(F.coalesce(col(previous_chance), F.lit(100.0)), F.lit(1.0)), 0.0, 1.25)
    before = F.greatest(col(minutes).cast("double"), F.lit(1.0))
    after = F.floor(before * ratio + 0.5)
    scale = clip(after / before, 0.0, 1.25)
    return {
        "ratio": ratio,
        "probability": F.floor(clip(col(probability) * ratio, None, 98.0) + 0.5),
        "minutes": after,
        "projected": col(projected) * scale,
    }


def counterfactual_score(c: dict, minutes=False, outcome=False, involvement=False, total=False) -> Column:
    """The score had some realised source been known: exposure, side outcome, own events, or all."""
    if total:
        return col(c["points"]).cast("double")
    position = col(c["position"])
    goal, clean_points = lookup(position, GOAL_POINTS), lookup(position, CLEAN_POINTS)
    slate = F.greatest(col(c["slate"]), F.lit(1)).cast("double")
    expected = col(c["expected_minutes"]) * slate
    ratio = F.when(expected > 0, col(c["minutes"]) / F.greatest(expected, F.lit(8.0))).otherwise(F.lit(0.0))
    ratio = clip(ratio, 0.0, 2.25)
    appearance, attack, clean, bonus = (col(c[k]) for k in ("appearance", "attack", "clean_route", "bonus_route"))
    if minutes:
        appearance = (col(c["appearances"]) + col(c["sixties"])).cast("double")
        attack, bonus = attack * ratio, bonus * ratio
        blended = clip(0.82 * col(c["side_clean"]) + 0.18 * col(c["clean_rate"]), 0.03, 0.78)
        clean = blended * clean_points * col(c["sixties"])
    if outcome:
        hoped = col(c["side_for"]) * slate
        scored = F.when(hoped > 0, col(c["side_goals"]) / F.greatest(hoped, F.lit(0.25))).otherwise(F.lit(0.0))
        attack = attack * clip(scored, 0.0, 2.75)
        sixty = col(c["sixties"]) if minutes else col(c["sixty"]) * slate
        clean = clean_points * sixty * (col(c["side_cleans"]) / F.greatest(col(c["side_games"]), F.lit(1)))
    if involvement:
        attack = col(c["goals"]) * goal + 3.0 * col(c["assists"])
    score = appearance + attack + clean + bonus + col(c["residual"])
    return clip(F.when(col(c["slate"]) == 0, F.lit(0.0)).otherwise(score), -2.0, 35.0)


def exposure_mixture(start, bench, minutes_start, minutes_bench) -> tuple[Column, Column]:
    """Mean and standard deviation of a start / bench / none exposure mixture."""
    start, bench = col(start), col(bench)
    a, b = col(minutes_start), col(minutes_bench)
    mean = clip(start * a + (1 - start) * bench * b, 3.0, 90.0)
    second = start * (a * a + 144.0) + (1 - start) * bench * (b * b + 100.0)
    return mean, clip(F.sqrt(F.greatest(second - mean * mean, F.lit(16.0))), 4.0, 42.0)


def slate_value(position, attack, defence) -> Column:
    """Attack and defence ratios mixed by position."""
    position, attack, defence = col(position), col(attack), col(defence)
    return first_match(
        [(position.isin(1, 2), 0.34 * attack + 0.66 * defence), (position == 3, 0.84 * attack + 0.16 * defence)],
        attack,
    )


def prediction_uncertainty(minutes_std, disagreement, observations) -> Column:
    total = (
        F.lit(1.1 * 1.1) + 0.020 * col(minutes_std) * col(minutes_std)
        + 0.85 * col(disagreement) * col(disagreement) + 2.2 / F.sqrt(col(observations) + 1)
    )
    return clip(F.sqrt(total), 1.2, 5.5)


def relative_uncertainty(std, projection, outside_gap, availability) -> Column:
    base = col(std) / F.greatest(col(projection) + col(std), F.lit(1.0))
    extra = 0.08 * col(outside_gap) + 0.10 * clip(1 - col(availability) / 100.0, 0.0, 1.0)
    return clip(base + extra, 0.05, 1.0)


def confidence(uncertainty) -> Column:
    return clip(100 * (1 - col(uncertainty)), 0.0, 95.0)


def labels(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Array of the labels whose rule holds, in order; a lone default when none does."""
    held = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
    return held if default is None else F.when(F.size(held) == 0, F.array(F.lit(default))).otherwise(held)


def verdict(percentile, sure) -> Column:
    percentile, sure = col(percentile), col(sure)
    return first_match(
        [
            ((percentile >= 0.90) & (sure >= 65), "Priority"),
            ((percentile >= 0.75) & (sure >= 55), "Strong"),
            (percentile >= 0.45, "Watch"),
        ],
        "Fade",
    )


def eligible(status, availability, price, minutes, ownership, outlook) -> Column:
    """Status a/d, availability >= 75, price >= 35 and any sign of activity."""
    active = (
        (F.coalesce(col(minutes), F.lit(0)) >= 180)
        | F.coalesce(col(ownership) >= 0.5, F.lit(False))
        | F.coalesce(col(outlook) >= 2.5, F.lit(False))
    )
    return col(status).isin("a", "d") & (col(availability) >= 75) & (col(price) >= 35) & active


def role(position, goal, assist, defence, saves) -> Column:
    """Scoring archetype: rules are listed weakest first and the last that holds wins."""
    p = col(position)
    g, a, d, s = (F.coalesce(col(x).cast("double"), F.lit(0.0)) for x in (goal, assist, defence, saves))
    # Archetype thresholds by position.
    named = [
        (p == 2, "balanced_defender"),
        (p == 3, "box_to_box_midfielder"),
        (p == 4, "mobile_forward"),
        ((p == 1) & (s >= 3.2), "shot_stopper"),
        ((p == 1) & (s < 3.2), "clean_sheet_keeper"),
        ((p == 2) & (d >= 7.8), "centre_back"),
        ((p == 2) & (a >= 0.13), "attacking_full_back"),
        ((p == 2) & (d >= 7.8) & (g >= 0.09), "set_piece_centre_back"),
        ((p == 3) & (d >= 7.2) & (g + a < 0.30), "holding_midfielder"),
        ((p == 3) & (a > g * 1.20) & (a >= 0.16), "creator"),
        ((p == 3) & (g >= 0.25), "goal_threat_midfielder"),
        ((p == 4) & (a >= 0.16), "link_forward"),
        ((p == 4) & (g >= 0.34), "penalty_box_forward"),
    ]
    return last_match(named, "balanced")
