from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from causal_panel.operators import scale


def skewed(seed: int = 3) -> pd.DataFrame:
    """One group holds most rows; values have a long tail, ties, negatives and nulls."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 40, 3000))
    v = np.round(rng.normal(0, 1, 3000) ** 5 * 10, 1)
    v[rng.random(3000) < 0.2] = 0.0
    frame = pd.DataFrame({"id": np.arange(3000), "g": g, "v": v})
    frame.loc[rng.random(3000) < 0.05, "v"] = None
    return frame


@pytest.fixture(scope="module")
def frames(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf).selectExpr("id", "g", "if(isnan(v), null, v) as v")


@pytest.mark.parametrize("rows_per_slice", [1, 7, 100, scale.ROWS_PER_SLICE])
def test_ordered_prefix_any_slicing(frames, rows_per_slice):
    pdf, df = frames
    got = scale.ordered_prefix(df, ["g"], "v", rows_per_slice=rows_per_slice).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    want = pdf.dropna().groupby(["g", "v"]).size().rename("n").reset_index()
    want["n_before"] = want.groupby("g")["n"].cumsum() - want["n"]
    want["n_total"] = want.groupby("g")["n"].transform("sum")
    assert len(got) == len(want)
    for c in ("n", "n_before", "n_total"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all()


def test_percentile_rank(frames):
    pdf, df = frames
    want = pdf.assign(want=pdf.groupby("g")["v"].transform(lambda s: s.rank(pct=True).fillna(0.5) if s.notna().sum() >= 2 else 0.5)).set_index("id")["want"]
    for ids in ((), ("id",)):
        got = scale.percentile_ranks(df, ["g"], {"v": "p"}, ids=ids).toPandas().set_index("id")["p"].sort_index()
        assert np.allclose(got.to_numpy(), want.sort_index().to_numpy())


def test_percentile_toy(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0), (3, 1, 2.0), (4, 1, None), (5, 2, 9.0)], "id int, g int, v double")
    got = [r["p"] for r in scale.percentile_rank(df, ["g"], "v", "p").orderBy("id").collect()]
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, 0.5, 0.5])


def test_exact_quantiles(frames):
    pdf, df = frames
    qs = {"a": ("v", 0.0), "b": ("v", 0.13), "c": ("v", 0.5), "d": ("v", 1.0)}
    got = scale.exact_quantiles(df, ["g"], qs).toPandas().set_index("g")
    for name, (_, q) in qs.items():
        want = pdf.dropna().groupby("g")["v"].quantile(q)
        assert np.allclose(got[name].sort_index(), want.sort_index())
    whole = scale.exact_quantiles(df, [], qs).first()
    assert whole["b"] == pytest.approx(pdf["v"].quantile(0.13))


@pytest.mark.parametrize("down", [False, True])
def test_ordinal_rank(frames, down):
    pdf, df = frames
    clean = pdf.dropna().sort_values(["g", "v", "id"], ascending=[True, not down, True])
    want = (clean.groupby("g").cumcount() + 1).set_axis(clean["id"]).sort_index()
    got = scale.ordinal_rank(df.dropna(), ["g"], "v", "id", "r", descending=down).toPandas().set_index("id")["r"].sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()


def test_narrow_bands_and_hot_groups_are_split(spark):
    """Instants close together in one group, half of all rows; a long tail in another."""
    from pyspark.sql import functions as F
    ids = spark.range(60_000)
    narrow = ids.select(F.lit(0).alias("g"), (F.lit(1.7e9) + F.col("id")).alias("v"))
    tail = ids.select(F.lit(1).alias("g"), F.exp(F.col("id") / 2000.0).alias("v"))
    df = narrow.unionByName(tail)
    out = scale.ordered_prefix(df, ["g"], "v", rows_per_slice=1000)
    sizes = scale.sliced(df.groupBy("g", "v").count(), ["g"], "v", 1000).groupBy("g", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000
    assert out.where("n_before + 1 > n_total or n_total <> 60000").count() == 0 and out.agg(F.count_distinct("g", "n_before")).first()[0] == 120_000
