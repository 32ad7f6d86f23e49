from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from causal_panel.functions import guards, markets, names, scalars, scoring


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_clip_keeps_null(spark):
    row = one(spark, scalars.clip(F.lit(None).cast("double"), 0, 1), scalars.clip(F.lit(7), 0, 1), scalars.clip(F.lit(-7), 0, 1))
    assert tuple(row) == (None, 1, 0)


@pytest.mark.parametrize("status,chance", [("a", 100), ("D", 75), ("i", 0), ("s", 0), ("u", 0), ("n", 0), ("x", 0), (None, 100)])
def test_status_default(spark, status, chance):
    assert one(spark, scalars.status_chance(F.lit(None), F.lit(status)))[0] == chance


def test_status_override_is_bounded(spark):
    row = one(spark, scalars.status_chance(F.lit("140"), F.lit("i")), scalars.status_chance(F.lit("bad"), F.lit("d")))
    assert tuple(row) == (100, 75)


@pytest.mark.parametrize("rate,k", [(0.0, 1), (0.4, 1), (2.5, 3), (7.0, 10), (12.0, 12)])
def test_poisson_tail(spark, rate, k):
    want = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k))
    row = one(spark, scalars.poisson_tail(F.lit(rate), k), scalars.poisson_tail(F.lit(rate), F.lit(k)))
    assert row[0] == pytest.approx(want, abs=1e-12) and row[1] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("z", [-3.0, -0.5, 0.0, 0.7, 2.4])
def test_normal_cdf(spark, z):
    assert one(spark, scalars.normal_cdf(F.lit(z)))[0] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1.6e-7)


@pytest.mark.parametrize("rate,d", [(0.0, 2), (1.3, 2), (3.7, 3), (29.0, 3)])
def test_floor_poisson_moments(spark, rate, d):
    mass = [math.exp(-rate) * rate**i / math.factorial(i) for i in range(51)]
    mean = sum(m * (i // d) for i, m in enumerate(mass))
    second = sum(m * (i // d) ** 2 for i, m in enumerate(mass))
    row = one(spark, *scalars.floor_poisson_moments(F.lit(rate), d))
    assert row[0] == pytest.approx(mean, rel=1e-9) and row[1] == pytest.approx(max(0, second - mean * mean), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("rate", [0.2, 0.31, 1.0, 2.0, 3.3, 6.5])
def test_implied_total_inverts(spark, rate):
    p = 1 - math.exp(-rate) * (1 + rate + rate * rate / 2)
    assert one(spark, markets.implied_total(F.lit(p)))[0] == pytest.approx(rate, abs=1e-6)


def test_implied_total_is_held_in_range(spark):
    row = one(spark, markets.implied_total(F.lit(0.0)), markets.implied_total(F.lit(1.0)))
    assert row[0] == pytest.approx(0.2) and row[1] == pytest.approx(6.5)


def test_no_vig_sums_to_one(spark):
    assert sum(one(spark, *markets.no_vig([F.lit(1.9), F.lit(3.4), F.lit(4.4)]))) == pytest.approx(1)
    with pytest.raises(ValueError):
        markets.no_vig([])


@pytest.mark.parametrize("play,start,sixty", [(0.9, 0.7, 0.5), (0.3, 0.8, 0.9), (1.0, 1.0, 1.0), (0.0, 0.5, 0.2)])
def test_minutes_mixture(spark, play, start, sixty):
    row = one(spark, *scoring.minutes_mixture(F.lit(play), F.lit(start), F.lit(sixty)).values())
    assert sum(row[:4]) == pytest.approx(1) and min(row[:4]) >= 0 and 0 <= row[4] <= 1


def test_blend_ends(spark):
    row = one(spark, markets.geometric_blend(F.lit(1.3), F.lit(2.2), 0.0), markets.geometric_blend(F.lit(1.3), F.lit(2.2), 1.0))
    assert row[0] == pytest.approx(1.3) and row[1] == pytest.approx(2.2)


@pytest.mark.parametrize("t,want", [(1, (1, 0, 0, 0)), (3, (0, 1, 0, 0)), (6, (0, 0, 1, 0)), (10, (0, 0, 0, 1)), (4.5, (0, 0.5, 0.5, 0)), (12, (0, 0, 0, 1)), (0, (1, 0, 0, 0))])
def test_knot_weights(spark, t, want):
    assert tuple(one(spark, *scalars.knot_weights(F.lit(float(t)), scoring.KNOTS))) == pytest.approx(want)


def test_resale(spark):
    row = one(spark, *[scoring.resale(F.lit(now), F.lit(45)) for now in (48, 40, 47, 45)])
    assert tuple(row) == (46, 40, 46, 45)


def test_age_and_names(spark):
    day = F.lit("2024-08-01").cast("date")
    row = one(spark, scalars.age_years(F.lit("2000-08-01T00:00"), day), scalars.age_years(F.lit("None"), day), names.name_key(F.lit("Éder O'Neil-Çağ 9")))
    assert row[0] == pytest.approx(24, abs=0.01) and row[1] is None and row[2].startswith("ederoneil")


def test_hard_unavailable(spark):
    null = F.lit(None).cast("double")
    row = one(
        spark, scoring.hard_unavailable(F.lit(1), F.lit("i"), null), scoring.hard_unavailable(F.lit(1), F.lit("i"), F.lit(0.0)),
        scoring.hard_unavailable(F.lit(0), F.lit("a"), F.lit(1.0)), scoring.hard_unavailable(F.lit(1), F.lit("a"), F.lit(0.0)),
    )
    assert tuple(row) == (False, True, True, False)


def test_guard(spark):
    df = spark.range(1).selectExpr("id", "1 as form", "2 as points")
    assert guards.guarded(df, ["id"], ["form"]).columns == ["id", "form"]
    with pytest.raises(ValueError):
        guards.guarded(df, ["id"], ["points"])
    with pytest.raises(KeyError):
        guards.guarded(df, ["id"], ["nothing"])


def test_affine_ragged_model_is_null(spark):
    model = F.struct(F.array(F.lit(1.0)).alias("centre"), F.array(F.lit(1.0), F.lit(2.0)).alias("scale"), F.array(F.lit(1.0), F.lit(2.0)).alias("coef"), F.lit(0.0).alias("intercept"))
    assert one(spark, scalars.affine_score([F.lit(1.0), F.lit(2.0)], model))[0] is None


def test_fit_goal_rates_recovers_grid_point(spark):
    grid = markets._outcome_grid(0.25, 14, 10)
    home, away, h, d, a, over = grid[40]
    row = spark.range(1).select(markets.fit_goal_rates(F.lit(h), F.lit(d), F.lit(a), F.lit(over), step=0.25, size=14).alias("r")).first()["r"]
    assert (row["home_rate"], row["away_rate"]) == pytest.approx((home, away))
