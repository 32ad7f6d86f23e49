"""Fits and quantiles of all earlier epochs at once, against plain loops over epochs."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causal_panel.operators.isotonic import expanding_isotonic, pooled
from causal_panel.operators.newton import Glm, expanding_glms, fitted
from causal_panel.operators.scale import expanding_quantiles


@pytest.fixture(scope="module")
def pdf():
    draw = np.random.default_rng(8)
    n = 1500
    frame = pd.DataFrame({"g": draw.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]), "epoch": draw.integers(0, 6, n), "v": np.round(draw.standard_cauchy(n) * 3, 1), "u": draw.integers(0, 9, n) / 2})
    frame.loc[::13, "v"] = np.nan
    return frame


@pytest.mark.parametrize("rows_per_slice", [250_000, 20])
def test_quantiles_of_earlier_epochs(spark, pdf, rows_per_slice):
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    asks = df.select("g", "epoch").distinct().withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 0.77, 1.0)])))
    found = expanding_quantiles(df, ["g"], "epoch", "v", asks, "out", rows_per_slice=rows_per_slice).toPandas()
    assert len(found) == asks.count()
    for r in found.itertuples():
        seen = pdf[(pdf["g"] == r.g) & (pdf["epoch"] < r.epoch)]["v"].dropna()
        assert np.isnan(r.out) if not len(seen) else abs(r.out - np.quantile(seen, r.q)) < 1e-9


@pytest.mark.parametrize("rows_per_slice", [250_000, 20])
def test_quantiles_beside_bounds(spark, pdf, rows_per_slice):
    df = spark.createDataFrame(pdf.dropna()).withColumn("u", F.when(F.col("u") > 0, F.col("u")))
    asks = spark.createDataFrame([(e, q, low, high) for e in range(1, 7) for q in (0.1, 0.9) for low, high in ((-np.inf, 1.0), (1.0, 3.0), (3.0, np.inf), (50.0, 60.0))], "epoch long, q double, low double, high double")
    found = expanding_quantiles(df, [], "epoch", "v", asks, "out", side="u", rows_per_slice=rows_per_slice).toPandas()
    own = pdf.dropna()
    for r in found.itertuples():
        seen = own[(own["epoch"] < r.epoch) & (own["u"] > 0) & (own["u"] > r.low) & (own["u"] <= r.high)]["v"]
        assert np.isnan(r.out) if not len(seen) else abs(r.out - np.quantile(seen, r.q)) < 1e-9


@pytest.mark.parametrize("rows_per_slice, fan", [(250_000, 64), (30, 2)])
def test_isotonic_against_one_pass(spark, rows_per_slice, fan):
    draw = np.random.default_rng(3)
    n = 900
    x = np.round(draw.random(n) * 6, 2)
    pdf = pd.DataFrame({"id": np.arange(n), "s": np.where(np.arange(n) % 4 == 0, "a", "b"), "epoch": np.arange(n) % 3, "x": x, "y": np.round(x + draw.normal(0, 2, n)), "on": np.arange(n) % 9 > 0})
    out = expanding_isotonic(spark.createDataFrame(pdf), "s", "x", "y", F.col("on"), "out", least=60, rows_per_slice=rows_per_slice, fan=fan).toPandas().set_index("id")["out"].sort_index()
    for s in "ab":
        for e in range(3):
            here = pdf[(pdf["s"] == s) & (pdf["epoch"] == e)]
            seen = pdf[(pdf["s"] == s) & (pdf["epoch"] < e) & pdf["on"]]
            expected = here["x"].to_numpy()
            if len(seen) >= 60:
                sums = seen.assign(y=seen["y"].clip(lower=0)).groupby("x")["y"].agg(["sum", "count"])
                pools = pooled(sums.index.to_numpy(), sums.index.to_numpy(), sums["sum"].to_numpy(float), sums["count"].to_numpy(float))
                assert (np.diff(pools[:, 2] / pools[:, 3]) > 0).all()
                means = sums["sum"].to_numpy() / sums["count"].to_numpy()
                prefix, weight = np.append(0, sums["sum"].cumsum()), np.append(0, sums["count"].cumsum())
                fit = [max(min((prefix[c + 1] - prefix[a]) / (weight[c + 1] - weight[a]) for c in range(b, len(means))) for a in range(b + 1)) for b in range(len(means))]
                expected = np.interp(here["x"], sums.index, fit)
            assert np.allclose(out[here["id"]], np.where(here["on"], expected, 0))


def test_newton_against_a_loop(spark):
    """Every fit's gradient vanishes, by numpy, for all families, keys and decays; rows of the own epoch are not read."""
    draw = np.random.default_rng(5)
    n = 1200
    pdf = pd.DataFrame({"k": draw.integers(0, 2, n), "epoch": draw.integers(0, 4, n), "x": draw.normal(2, 1.5, n), "z": draw.random(n), "w": 1 + draw.random(n)})
    pdf["c"] = draw.poisson(np.exp(0.2 + 0.3 * pdf["x"] - pdf["z"])).astype(float)
    pdf["b"] = (draw.random(n) < 1 / (1 + np.exp(1 - pdf["x"]))).astype(float)
    pdf.loc[::17, "b"] = np.nan
    models = [Glm("p", "c", "poisson", 0.35, 0.9, of_mean=True), Glm("l", "b", "logistic", 2.0, 0.8, "w"), Glm("r", "c", "gaussian", 5.0)]
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    fits = expanding_glms(df, ["x", "z"], models, df, keys=["k"])
    rows = fits.collect()
    assert len(rows) == 2 * 3 * 3
    for r in rows:
        m = next(m for m in models if m.name == r["_model"])
        seen = pdf[(pdf["k"] == r["k"]) & (pdf["epoch"] < r["epoch"])]
        x = seen[["x", "z"]].to_numpy()
        assert np.allclose(r["_mean"], x.mean(axis=0)) and np.allclose(r["_scale"], x.std(axis=0))
        design = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
        line = design @ np.array(r["_b"])
        mu = {"poisson": np.exp(line), "logistic": 1 / (1 + np.exp(-line)), "gaussian": line}[m.family]
        w = m.decay ** (r["epoch"] - seen["epoch"] - 1) * (seen[m.weight] if m.weight else 1)
        y, w = seen[m.y].fillna(0), np.where(seen[m.y].notna(), w, 0)
        slope = design.T @ (w * (mu - y)) / (w.sum() if m.of_mean else 1) + m.penalty * np.array([0, *r["_b"][1:]])
        assert np.abs(slope).max() < 1e-7 * max(1, w.sum())
    scored = fitted(df, fits, "p", ["x", "z"], "poisson", keys=["k"]).toPandas()
    assert len(scored) == n and scored["value"].isna().sum() == (pdf["epoch"] == 0).sum()


def test_gaps_across_stretches(spark):
    """Least gaps per side are the same whether a line is cut or not, and those of a plain loop."""
    from causal_panel.operators.windows import congestion

    draw = np.random.default_rng(9)
    at = pd.to_datetime("2020-01-01") + pd.to_timedelta(np.sort(draw.integers(0, 4_000_000, 600)), unit="min")
    pdf = pd.DataFrame({"h": draw.choice(["a", "b", "c"], 600, p=[0.8, 0.15, 0.05]), "a": draw.choice(["d", "e"], 600), "at": at})
    pdf.loc[600] = ["once", "d", pd.Timestamp("2030-01-01")]
    df = spark.createDataFrame(pdf)
    expected = {}
    for side in ("a", "b", "c", "d", "e", "once"):
        times = np.sort(pdf[(pdf["h"] == side) | (pdf["a"] == side)]["at"].to_numpy())
        expected[side] = float(np.diff(times).min() / np.timedelta64(1, "D")) if len(times) > 1 else 7.0
    for rows in (250_000, 25):
        found = {r.side: r.minimum_gap for r in congestion(df, "h", "a", "at", rows_per_slice=rows).collect()}
        assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in expected)


def test_newton_passes_meet_blocks_not_rows(spark, monkeypatch):
    """A pass multiplies matrices of one epoch: it reads a row per block, not one per row and later fit."""
    from causal_panel.operators import newton

    seen, settle = {}, newton.settle
    monkeypatch.setattr(newton, "settle", lambda df, name: seen.setdefault(name, settle(df, name)))
    df = spark.range(6_000).repartition(2).selectExpr("cast(id % 3 as int) as epoch", "(id * 37 % 101) / 50.0 as x", "id % 7 * 1.0 as y")
    expanding_glms(df, ["x"], [Glm("g", "y", "gaussian", 1.0)], df, steps=1)
    blocks = seen["newton-rows"].collect()
    assert len(blocks) <= 12 and sum(len(r["_flat"]) for r in blocks) == 6_000 * 3
