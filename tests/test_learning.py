"""Walk-forward fits: earlier epochs only, every row back, better than the baseline where there is something to learn."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causal_panel.operators import learning as m
from causal_panel.operators.isotonic import expanding_isotonic


@pytest.fixture(scope="module")
def pdf():
    draw = np.random.default_rng(4)
    n = 1200
    x = draw.random(n) * 4
    return pd.DataFrame({
        "id": np.arange(n), "epoch": np.arange(n) % 4, "stratum": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": x, "z": draw.random(n),
        "y": np.round(1 + 2 * x + draw.normal(0, 0.3, n)), "base": 4.0, "on": (np.arange(n) % 10 > 0),
    })


def run(spark, pdf, fit):
    out = fit(spark.createDataFrame(pdf)).select("id", "out").toPandas().set_index("id")["out"].sort_index()
    return out


FITS = {
    "trees": lambda d: m.walk_forward_trees(d, ["x", "z"], "y", F.col("on"), "base", "out", "y", trees=3, depth=3),
    "isotonic": lambda d: expanding_isotonic(d, "stratum", "x", "y", F.col("on"), "out", least=50),
}


@pytest.mark.parametrize("name", list(FITS))
def test_walk_forward(spark, pdf, name):
    out = run(spark, pdf, FITS[name])
    assert len(out) == len(pdf) and (out[~pdf["on"]] == 0).all()
    later = pdf["on"] & (pdf["epoch"] > 0)
    assert np.abs(out - pdf["y"])[later].mean() < 0.6 * np.abs(pdf["base"] - pdf["y"])[later].mean()
    first = pdf["on"] & (pdf["epoch"] == 0)
    assert (out[first] == (pdf["base"] if name == "trees" else pdf["x"])[first]).all()
    changed = pdf.assign(y=pdf["y"].where(pdf["epoch"] < 2, pdf["y"] * 3 + 1))
    again = run(spark, changed.sample(frac=1, random_state=1), FITS[name])
    known = pdf["epoch"] <= 2  # trees draw their samples in the order of the rows, so they agree but for that
    assert np.abs(out - again)[known].max() < 1e-6 if name == "isotonic" else np.abs(out - again)[known].mean() < 0.1


def test_rows_without_a_stratum_stay(spark, pdf):
    holes = pdf.assign(stratum=pdf["stratum"].where(pdf["id"] % 5 > 0, None))
    out = run(spark, holes, FITS["isotonic"])
    hole = (pdf["id"] % 5 == 0) & pdf["on"]
    assert len(out) == len(pdf) and np.allclose(out[hole], pdf["x"][hole])


def test_market_model_keeps_early_epochs(spark, pdf):
    sides = spark.createDataFrame(pdf.assign(scored=np.floor(pdf["x"]))).select("id", "epoch", "x", "z", "scored")
    out = m.market_model(sides, ["x", "z"], {"x": F.col("z"), "z": F.col("x")}, "scored", F.col("scored") == 0, 2).toPandas().set_index("id").sort_index()
    assert len(out) == len(pdf)
    early = pdf["epoch"] < 2
    assert out["expected_for"][early].isna().all() and out["expected_for"][~early].between(0.2, 4.2).all() and out["clean_chance"][~early].between(0.02, 0.8).all()
    assert np.corrcoef(out["expected_for"][~early], pdf["x"][~early])[0, 1] > 0.8


def test_actions_agree_and_learn_from_earlier_epochs(spark, pdf):
    df = spark.createDataFrame(pdf.assign(gain=pdf["y"] - 5))
    out = m.action_fits(df, ["x", "z"], "gain", least=100).toPandas()
    assert set(out["epoch"]) == {1, 2, 3} and len(out) == (pdf["epoch"] > 0).sum()
    assert np.abs(out["value"] - out["gain"]).mean() < 0.6
    kept = out[out["accepted"]]
    assert len(kept) and (kept["value"] > 0).all() and (kept["win"] >= 0.5).all() and (kept["gap"] <= kept["limit"]).all()
    metrics = m.action_metrics(df.sparkSession.createDataFrame(out), "gain").first()
    assert metrics["rows"] == len(out) and metrics["accepted_gain"] > metrics["rejected_gain"]
