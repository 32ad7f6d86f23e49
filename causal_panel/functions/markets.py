"""Odds, order books and rate blending as Column expressions."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clip, col, logit


def no_vig(odds: Sequence) -> list[Column]:
    """Probabilities from decimal odds, scaled to sum to one."""
    if not odds:
        raise ValueError("no odds given")
    inverse = [1 / clip(col(o).cast("double"), 1.001) for o in odds]
    total = sum(inverse[1:], inverse[0])
    return [i / total for i in inverse]


def implied_total(over_probability, low: float = 0.20, high: float = 6.50) -> Column:
    """The Poisson rate with P(X >= 3) equal to the given probability, held in [low, high].

    Newton steps from rate 2, where the probability has its only turn in curvature: from there
    they approach the root from one side. Sixteen steps settle every rate in the range.
    """
    p = col(over_probability).cast("double")

    def over(rate):
        return 1 - F.exp(-rate) * (1 + rate + 0.5 * rate * rate)

    bounded = F.least(F.greatest(p, over(F.lit(low))), over(F.lit(high)))
    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(16)), F.lit(2.0),
        lambda x, _: x - (over(x) - bounded) / (0.5 * x * x * F.exp(-x)),
    )
    return F.when(p.isNotNull(), root)


def order_book(prices: Column) -> tuple[Column, Column, Column]:
    """(probability, liquidity, relative spread) from array<struct<side, odds, amount>>.

    The best back is the longest odds above one, the best lay the shortest; the
    amount breaks ties. All three follow from the best row of each side.
    """

    def best(side, pick):
        rows = F.filter(prices, lambda p: (p["side"] == side) & (p["odds"] > 1))
        return pick(F.transform(rows, lambda p: F.struct(p["odds"].alias("odds"), p["amount"].alias("amount"))))

    back, lay = best("back", F.array_max), best("lay", F.array_min)
    b, l = back["odds"], lay["odds"]
    both = b.isNotNull() & l.isNotNull()
    probability = F.when(both, (1 / b + 1 / l) / 2).otherwise(F.coalesce(1 / b, 1 / l))
    liquidity = F.coalesce(back["amount"], F.lit(0.0)) + F.coalesce(lay["amount"], F.lit(0.0))
    return probability, liquidity, F.when(both, (l - b) / F.sqrt(l * b))


def market_quality(volume, spreads: Sequence) -> Column:
    """0.65 of a log-volume score and 0.35 of a spread score, in 0.2..1."""
    widest = F.coalesce(F.greatest(*[col(s) for s in spreads]) if len(spreads) > 1 else col(spreads[0]), F.lit(0.25))
    by_volume = clip(F.log1p(F.coalesce(col(volume), F.lit(0.0))) / F.log1p(F.lit(25000.0)), None, 1.0)
    by_spread = clip(1 - widest / 0.18, 0.15, 1.0)
    return clip(0.65 * by_volume + 0.35 * by_spread, 0.2, 1.0)


def geometric_blend(first, second, weight) -> Column:
    a, b = clip(col(first), 0.05, 6.0), clip(col(second), 0.05, 6.0)
    return F.exp((1 - weight) * F.log(a) + weight * F.log(b))


def probability_blend(first, second, weight) -> Column:
    mixed = (1 - weight) * logit(first) + weight * logit(second)
    return clip(1 / (1 + F.exp(-mixed)), 0.01, 0.90)


def _outcome_grid(step: float, size: int, most: int) -> np.ndarray:
    """Rows (home rate, away rate, home, draw, away, over 2.5) for every pair of grid rates."""
    rates = 0.25 + step * np.arange(size)
    counts = np.arange(most + 1)
    factorial = np.cumprod(np.r_[1.0, counts[1:]])
    mass = np.exp(-rates)[:, None] * rates[:, None] ** counts / factorial
    joint = mass[:, None, :, None] * mass[None, :, None, :]
    diff = counts[:, None] - counts[None, :]
    total = counts[:, None] + counts[None, :]
    home, draw, away = (joint[..., m].sum(-1) for m in (diff > 0, diff == 0, diff < 0))
    over = joint[..., total >= 3].sum(-1)
    whole = home + draw + away
    a, b = np.meshgrid(rates, rates, indexing="ij")
    return np.stack([a, b, home / whole, draw / whole, away / whole, over], axis=-1).reshape(-1, 6)


def fit_goal_rates(home, draw, away, over=None, step: float = 0.04, size: int = 88, most: int = 10) -> Column:
    """The grid pair of Poisson rates whose outcome probabilities are nearest to the given ones.

    Squared loss over home/draw/away plus 0.65 times that of over 2.5 where given; the
    first pair in grid order wins ties. The grid has size^2 rows, whatever the data.
    """
    built: list[np.ndarray] = []  # once per task

    @F.pandas_udf("struct<home_rate: double, away_rate: double>")
    def fit(h: pd.Series, d: pd.Series, a: pd.Series, o: pd.Series) -> pd.DataFrame:
        grid = built[0] if built else built.append(_outcome_grid(step, size, most)) or built[0]
        target = np.column_stack([h, d, a]).astype(float)
        over_p = o.to_numpy(float)
        best = np.empty(len(target), dtype=int)
        for start in range(0, len(target), 256):
            part = slice(start, start + 256)
            loss = sum((target[part, i, None] - grid[None, :, 2 + i]) ** 2 for i in range(3))
            extra = 0.65 * (grid[None, :, 5] - over_p[part, None]) ** 2
            best[part] = np.argmin(loss + np.nan_to_num(extra), axis=1)
        return pd.DataFrame({"home_rate": grid[best, 0], "away_rate": grid[best, 1]})

    over = F.lit(None).cast("double") if over is None else col(over)
    return fit(col(home), col(draw), col(away), over)


def blend_sources(market, published) -> Column:
    """70/30 of market and published where both exist, else the one present, else null."""
    market, published = col(market), col(published)
    both = market.isNotNull() & published.isNotNull()
    return F.when(both, 0.70 * market + 0.30 * published).otherwise(F.coalesce(market, published))


def market_weight(quality) -> Column:
    """Share of the outside rate: clip(0.92 * quality, 0, 0.82), nil without a market."""
    return F.coalesce(clip(0.92 * col(quality), 0.0, 0.82), F.lit(0.0))
