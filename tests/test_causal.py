"""Windows and estimators: known cases, no look-ahead, order of input rows does not matter."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causal_panel.operators import estimators as est
from causal_panel.operators import windows as w


def make_panel(seed=5, entities=24, epochs=3, periods=8):
    rng = np.random.default_rng(seed)
    rows = [
        (e, ep, ep * periods + p, 1 + e % 4, int(rng.poisson(4)), int(rng.random() > 0.15), float(np.round(rng.gamma(4, 1), 2)), float(np.round(rng.gamma(3, 1), 2)))
        for e in range(entities) for ep in range(epochs) for p in range(periods) if rng.random() > 0.1
    ]
    return pd.DataFrame(rows, columns=["entity", "epoch", "period", "position", "points", "slate", "fa", "fb"])


@pytest.fixture(scope="module")
def pdf():
    return make_panel()


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return spark.createDataFrame(pdf)


def test_ewm_with_gap(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 9.0)], "t int, x double").withColumn("k", F.lit(1))
    got = [r["y"] for r in w.attach_prior_ewm(df, {"y": ("x", 0.3)}, w.timeline("k", "t")).orderBy("t").collect()]
    assert got[0] is None and got[1] == 1.0 and got[2] == 1.0
    assert got[3] == pytest.approx((0.49 * 1 + 0.3 * 2) / 0.79)


def test_ewm_after_200_missing_rows(spark):
    df = spark.createDataFrame([(k, 3.0 if k < 5 else 8.0 if k == 230 else None) for k in range(260)], "t int, x double").withColumn("k", F.lit(1))
    got = [r["y"] for r in w.attach_prior_ewm(df, {"y": ("x", 0.22)}, w.timeline("k", "t")).orderBy("t").collect()]
    assert got[0] is None and got[1:231] == [3.0] * 230 and got[231:] == pytest.approx([8.0] * 29)


def test_ewm_is_pandas(spark, pdf, panel):
    x = F.when(F.col("slate") > 0, F.col("points"))
    got = w.attach_prior_ewm(panel, {"y": (x, 0.22)}, w.timeline("entity", "period")).toPandas().sort_values(["entity", "period"])["y"].to_numpy()
    local = pdf.sort_values(["entity", "period"]).assign(x=lambda d: d["points"].where(d["slate"] > 0))
    want = local.groupby("entity")["x"].transform(lambda s: s.ewm(alpha=0.22, adjust=False).mean().shift(1)).to_numpy()
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_rolling_min_periods(spark):
    df = spark.createDataFrame([(1, 4.0), (2, None), (3, 6.0), (4, 8.0)], "t int, x double").withColumn("k", F.lit(1))
    line = w.timeline("k", "t")
    got = [tuple(r)[1:] for r in df.select("t", w.prior_mean("x", line, 2, 2), w.prior_mean("x", line, 2)).orderBy("t").collect()]
    assert got == [(None, None), (None, 4.0), (None, 4.0), (None, 6.0)]


def test_forward_label(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 6)], "gw int, points int").withColumn("k", F.lit(1))
    line = w.timeline("k", "gw")
    three, ten = w.forward_label("points", "gw", line, 3), w.forward_label("points", "gw", line, 10)
    rows = df.select("gw", three[0].alias("a"), three[1].alias("b"), ten[1].alias("c")).orderBy("gw").collect()
    assert rows[0]["a"] == pytest.approx(4.9388) and rows[0]["b"] == 3 and rows[3]["c"] == 5


def test_event_numbers_follow_order_not_numbers(spark):
    df = spark.createDataFrame([(0, g) for g in (28, 29, 39, 40)], "epoch int, period int")
    assert [r["remaining"] for r in w.event_numbers(df, "epoch", "period").orderBy("period").collect()] == [4, 3, 2, 1]


def seen():
    return F.col("slate") > 0


def hit():
    return F.when(F.col("points") >= 5, 1.0).otherwise(0.0)


def with_labels(df):
    total, end = w.forward_label("points", "period", w.timeline(["epoch", "entity"], "period"), 3)
    return df.withColumn("t3", total).withColumn("e3", end)


def xs():
    return [F.lit(1.0), F.col("fa") / 5, F.col("fb") / 5]


CAUSAL = {
    "rolling": lambda d: d.withColumn("out", F.coalesce(w.prior_mean("points", w.timeline("entity", "period"), 4), F.lit(0))),
    "ewm": lambda d: w.attach_prior_ewm(d, {"out": ("points", 0.3)}, w.timeline("entity", "period")).fillna(0, ["out"]),
    "calibration": lambda d: est.expanding_calibration(d.withColumn("p", F.col("fa") / (F.col("fa") + 5)), "position", "p", hit(), 0.12, seen(), "out"),
    "half_width": lambda d: est.expanding_half_width(d, "position", F.col("points") - F.col("fa"), "fb", seen(), least=20).withColumnRenamed("half_width", "out"),
    "online_ridge": lambda d: est.online_ridge(d, "position", xs(), F.col("points"), "fa", seen(), "out", [0.2, 8, 8], least=10),
    "matured_ridge": lambda d: est.matured_ridge(with_labels(d), "position", xs(), F.col("t3"), "e3", "fa", "out", [0.25, 12, 12], 20, 10),
    "ensemble": lambda d: est.inverse_error_weights(d, "position", {"fa": 2.85, "fb": 3.05}, "points", seen()).withColumnRenamed("w_fa", "out"),
    "selection_bias": lambda d: est.selection_bias(with_labels(d), "position", "fa", "t3", "e3", "entity", seen()).withColumnRenamed("bias", "out"),
    "season_ahead": lambda d: est.season_ahead_ridge(d, "position", ["fa", "fb"], ["points"], seen(), seen(), ["out"], ["fa"]),
}


@pytest.mark.parametrize("name", list(CAUSAL))
def test_no_look_ahead(spark, pdf, panel, name):
    """Multiplying targets at and after a deadline leaves everything up to it as it was."""
    cut = 13 if name != "season_ahead" else 8
    changed = spark.createDataFrame(pdf.assign(points=pdf["points"].where(pdf["period"] < cut, pdf["points"] * 7 + 3)))
    upto = (F.col("period") <= cut) if name != "season_ahead" else (F.col("epoch") <= 1)
    keys = ["entity", "period"]
    one = CAUSAL[name](panel).where(upto).select(*keys, "out").toPandas().sort_values(keys)["out"].to_numpy(float)
    two = CAUSAL[name](changed).where(upto).select(*keys, "out").toPandas().sort_values(keys)["out"].to_numpy(float)
    assert len(one) and np.allclose(one, two, atol=1e-9)


@pytest.mark.parametrize("name", ["calibration", "online_ridge", "selection_bias"])
def test_input_order_does_not_matter(panel, name):
    keys = ["entity", "period"]
    one = CAUSAL[name](panel).select(*keys, "out").toPandas().sort_values(keys)["out"].to_numpy(float)
    two = CAUSAL[name](panel.repartition(7, "points").orderBy(F.rand(3))).select(*keys, "out").toPandas().sort_values(keys)["out"].to_numpy(float)
    assert np.allclose(one, two, atol=1e-9)


def matrix(local):
    return np.column_stack([np.ones(len(local)), local["fa"] / 5, local["fb"] / 5])


def test_online_ridge_is_the_loop(pdf, panel):
    penalty = np.diag([0.2, 8, 8])
    local = pdf.sort_values(["epoch", "period", "position", "entity"]).reset_index(drop=True)
    want = local["fa"].to_numpy().copy()
    state = {}
    for _, group in local.groupby(["epoch", "period"], sort=True):
        for role, rows in group.groupby("position"):
            g, h, n = state.get(role, (np.zeros((3, 3)), np.zeros(3), 0))
            if n >= 10:
                b = np.linalg.solve(g + penalty, h)
                score = rows[rows["slate"] > 0]
                want[score.index] = np.clip(matrix(score) @ b, 0.15, 14)
            x = matrix(rows)
            state[role] = (g + x.T @ x, h + x.T @ rows["points"].to_numpy(float), n + len(rows))
    got = CAUSAL["online_ridge"](panel).toPandas().sort_values(["epoch", "period", "position", "entity"])["out"].to_numpy()
    assert np.allclose(got, want)


def test_update_on_observed_only(panel, pdf):
    every = est.online_ridge(panel, "position", xs(), F.col("points"), "fa", seen(), "out", [0.2, 8, 8], least=10)
    some = est.online_ridge(panel, "position", xs(), F.col("points"), "fa", seen(), "out", [0.2, 8, 8], least=10, update_on="observed")
    assert every.agg(F.sum("out")).first()[0] != some.agg(F.sum("out")).first()[0]


def numpy_season_ridge(train, test, columns, target, alpha, decay, epoch):
    med = train[columns].median()
    x, t = train[columns].fillna(med).to_numpy(float), test[columns].fillna(med).to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-12, std, 1)
    z, y = (x - mean) / std, train[target].to_numpy(float)
    wt = decay ** (epoch - train["epoch"].to_numpy() - 1)
    zc, yc = np.average(z, axis=0, weights=wt), np.average(y, weights=wt)
    a = ((z - zc) * wt[:, None]).T @ (z - zc) + alpha * np.eye(len(columns))
    b = np.linalg.solve(a, ((z - zc) * wt[:, None]).T @ (y - yc))
    return np.clip(yc + ((t - mean) / std - zc) @ b, 0, 70)


@pytest.mark.parametrize("impute", [False, True])
def test_season_ahead_ridge(spark, pdf, panel, impute):
    data = pdf.copy()
    if impute:
        data.loc[data.index % 5 == 0, "fb"] = np.nan
    df = spark.createDataFrame(data).withColumn("fb", F.when(~F.isnan("fb"), F.col("fb")))
    out = est.season_ahead_ridge(df, "position", ["fa", "fb"], ["points"], seen(), seen(), ["out"], ["fa"], impute=impute).toPandas()
    for epoch in (1, 2):
        for position in (1, 2, 3, 4):
            train = data[(data["epoch"] < epoch) & (data["position"] == position) & (data["slate"] > 0)]
            test = data[(data["epoch"] == epoch) & (data["position"] == position) & (data["slate"] > 0)].sort_values(["entity", "period"])
            want = numpy_season_ridge(train, test, ["fa", "fb"], "points", 80.0, 0.88, epoch)
            got = out[(out["epoch"] == epoch) & (out["position"] == position) & (out["slate"] > 0)].sort_values(["entity", "period"])["out"].to_numpy()
            assert np.allclose(got, want)


def test_best_nonnegative_against_grid():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.normal(size=(40, 3))
        a, c = x.T @ x, x.T @ rng.normal(size=40) + rng.normal(size=3) * 5
        best = est._best_nonnegative(a, c, 2.0)
        full = a + 2 * np.eye(3)
        step = np.zeros(3)
        for _ in range(20000):
            step = np.maximum(0, step - 0.5 / np.linalg.norm(full, 2) * (full @ step - c))
        assert np.allclose(best, step, atol=1e-5)


def test_isotonic_map(spark):
    counts = {f"n{i}": 0 for i in range(10)} | {f"s{i}": 0 for i in range(10)}
    counts |= {"n0": 1000, "s0": 300, "n1": 1000, "s1": 100, "n2": 1000, "s2": 500}
    df = spark.createDataFrame([counts])
    got = est._isotonic_map(df, 0.12, 0.0001, 0.0001).first()["map"]
    assert got[0] == pytest.approx(0.2, abs=1e-3) and got[1] == pytest.approx(0.2, abs=1e-3) and got[2] >= 0.3
    assert all(a <= b + 1e-12 for a, b in zip(got, got[1:]))


def test_quantile_map_keeps_scale_and_zeroes_last(panel, pdf):
    out = est.quantile_map(panel, ["period", "position"], "entity", "fb", "fa", "m", "slate").toPandas()
    for _, g in out.groupby(["period", "position"]):
        order = g.sort_values(["fb", "entity"])
        want = np.where(order["slate"] == 0, 0, np.sort(g["fa"]))
        assert np.allclose(order["m"], want)
