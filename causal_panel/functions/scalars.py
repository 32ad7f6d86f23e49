"""Null-preserving numeric helpers and probability functions as Column expressions."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value, low=None, high=None) -> Column:
    """Bound a value; null stays null (bare least/greatest would skip it)."""
    value = col(value)
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def sigmoid(value) -> Column:
    return 1 / (1 + F.exp(-clip(col(value), -18.0, 18.0)))


def logit(value) -> Column:
    bounded = clip(col(value), 0.01, 0.99)
    return F.log(bounded / (1 - bounded))


def signed_log(value) -> Column:
    value = col(value)
    return F.signum(value) * F.log1p(F.abs(value))


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default)


def last_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """The value of the last rule that holds, as if the rules were assigned in turn."""
    return first_match(list(reversed(list(rules))), default)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as a conditional chain; unknown keys give `default`."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


# Chance of taking part by status letter when no number is given.
STATUS_CHANCE = {"a": 100.0, "d": 75.0, "i": 0.0, "s": 0.0, "u": 0.0, "n": 0.0}


def status_chance(chance, status) -> Column:
    """Numeric chance when it parses, else the status default (missing status is 'a'), in 0..100."""
    letter = F.lower(F.coalesce(col(status), F.lit("a")))
    number = col(chance).cast("string").try_cast("double")
    return clip(F.coalesce(number, lookup(letter, STATUS_CHANCE, 0.0)), 0.0, 100.0)


def age_years(text, on: Column) -> Column:
    """Age on a date from a text date; only the first ten characters count, bad text is null."""
    born = F.try_to_date(F.substring(col(text).cast("string"), 1, 10), "yyyy-MM-dd")
    return F.datediff(on, born) / F.lit(365.2425)


def gaussian_kernel(value, centre: float, width: float) -> Column:
    """exp(-((x - centre) / width)^2); an unknown x counts as the centre."""
    z = (F.coalesce(col(value).cast("double"), F.lit(centre)) - centre) / width
    return F.exp(-(z * z))


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = F.lit(float(c)) + x * out
    return out


def poisson_tail(rate, k) -> Column:
    """P(X >= k) for a Poisson rate; k is an int, or an integer column."""
    rate = col(rate).cast("double")
    if isinstance(k, int):
        below = F.exp(-rate) * _horner(rate, [1 / math.factorial(i) for i in range(max(1, k))])
    else:
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int")))
        start = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("s"))
        below = F.aggregate(
            steps,
            start,
            lambda a, i: F.struct((a["p"] * rate / i).alias("p"), (a["s"] + a["p"]).alias("s")),
            lambda a: a["s"],
        )
    return clip(1 - below, 0.0, 1.0)


# Error-function approximation 7.1.26 (absolute error below 1.5e-7).
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(value) -> Column:
    x = col(value) / F.lit(math.sqrt(2))
    t = 1 / (1 + _ERF_P * F.abs(x))
    tail = t * _horner(t, _ERF_A) * F.exp(-(x * x))
    return F.lit(0.5) * (1 + F.signum(x) * (1 - tail))


def floor_poisson_moments(rate, divisor: int, terms: int = 50) -> tuple[Column, Column]:
    """Mean and variance of floor(X / divisor) for a Poisson X with rate in 0..30."""
    lam = clip(col(rate).cast("double"), 0.0, 30.0)
    weights = [i // divisor for i in range(terms + 1)]
    first = [w / math.factorial(i) for i, w in enumerate(weights)]
    second = [w * w / math.factorial(i) for i, w in enumerate(weights)]
    mean = F.exp(-lam) * _horner(lam, first)
    variance = F.exp(-lam) * _horner(lam, second) - mean * mean
    return mean, clip(variance, 0.0)


def shrunk_rate(successes, trials, prior, strength: float) -> Column:
    """(successes + strength * prior) / (trials + strength)."""
    return (col(successes) + strength * prior) / (col(trials) + strength)


def population_std(values: Sequence) -> Column:
    """Population standard deviation across columns of one row."""
    n = len(values)
    mean = sum((col(v) for v in values[1:]), col(values[0])) / n
    squares = [(col(v) - mean) * (col(v) - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / n)


def affine_score(features: Sequence, model: Column) -> Column:
    """intercept + sum(coef * (x - centre) / scale); null when a part is missing or ragged.

    `model` is a struct with arrays `centre`, `scale`, `coef` and a double `intercept`.
    """
    xs = F.array(*[col(f).cast("double") for f in features])
    standard = F.zip_with(
        F.zip_with(xs, model["centre"], lambda x, c: x - c),
        model["scale"],
        lambda d, s: d / F.when(s > 0, s).otherwise(F.lit(1.0)),
    )
    total = F.aggregate(
        F.zip_with(standard, model["coef"], lambda z, b: z * b), F.lit(0.0), lambda a, v: a + v
    )
    size = F.lit(len(features))
    whole = (F.size(model["centre"]) == size) & (F.size(model["scale"]) == size) & (F.size(model["coef"]) == size)
    return F.when(whole, model["intercept"] + total)


def interpolate_knots(x, knots: Sequence[float], values: Sequence) -> Column:
    """Piecewise-linear value through (knot, column) pairs, flat outside the knots."""
    x, values = col(x), [col(v) for v in values]
    out = F.when(x < knots[0], values[0])
    for i in range(len(knots) - 1):
        share = (x - knots[i]) / F.lit(float(knots[i + 1] - knots[i]))
        out = out.when(x < knots[i + 1], (1 - share) * values[i] + share * values[i + 1])
    return out.when(x >= knots[-1], values[-1])


def knot_weights(x, knots: Sequence[float]) -> list[Column]:
    """Interpolation weights over the knots; they sum to one."""
    one_hot = [[F.lit(1.0 if i == j else 0.0) for j in range(len(knots))] for i in range(len(knots))]
    return [interpolate_knots(x, knots, [row[i] for row in one_hot]) for i in range(len(knots))]
