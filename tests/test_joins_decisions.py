"""Joins and decision rules against brute force on small frames, with one crowded group."""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causal_panel.operators import aggs, decisions, joins


def crowd(n=260, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n)), "price": rng.integers(40, 90, n),
        "f": np.round(rng.normal(4, 2, n), 1), "y": rng.integers(-2, 14, n), "z": np.round(rng.normal(0, 1, n), 2), "back": rng.random(n) < 0.5,
        "side": rng.integers(0, 6, n),
    })


def test_near_price_pairs_brute_force(spark):
    pdf = crowd()
    got = joins.near_price_pairs(spark.createDataFrame(pdf), ["g"], "price", "f", "y", band=15).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        pairs = good = 0
        for a, b in itertools.combinations(rows.itertuples(), 2):
            if abs(a.price - b.price) <= 15 and a.y != b.y:
                pairs += 1
                good += np.sign(a.y - b.y) == np.sign(a.f - b.f)
        if pairs:
            assert tuple(got.loc[g, ["pairs", "ordered"]]) == (pairs, good)


@pytest.mark.parametrize("band", [0, 1, 5])
def test_near_price_pairs_any_band_and_outcome(spark, band):
    pdf = crowd().head(120)
    pdf["y"] = pdf["y"] * 10_000 - 50_000
    pdf["price"] = pdf["price"] - 60  # prices below zero too
    got = joins.near_price_pairs(spark.createDataFrame(pdf), ["g"], "price", "f", "y", band=band).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        found = [np.sign(a.y - b.y) == np.sign(a.f - b.f) for a, b in itertools.combinations(rows.itertuples(), 2) if abs(a.price - b.price) <= band and a.y != b.y]
        assert (tuple(got.loc[g, ["pairs", "ordered"]]) if g in got.index else (0, 0)) == (len(found), sum(found))


def test_large_squads_block_all_they_hold(spark):
    """Twenty owned offers of one price come before the one that is free."""
    owned = spark.createDataFrame([(1, 1, k, 1, k, 50, 0, 1.0) for k in range(20)], "decision int, deadline int, entity int, position int, side int, sale_price int, bank int, score double")
    market = spark.createDataFrame([(1, k, 1, 99, 50, 100.0 - k, 1) for k in range(21)], "deadline int, entity int, position int, side int, price int, score double, slate int")
    best = joins.best_replacement(owned, market, "decision", "deadline").collect()
    assert len(best) == 20 and {r["replacement"] for r in best} == {20}


def test_spines_and_slots(spark):
    df = spark.createDataFrame([(9, 1, 2, 1), (9, 1, 7, 1), (9, 2, 4, 1), (8, 3, 5, 1)], "epoch int, entity int, period int, v int")
    dense = joins.dense_spine(df, "epoch", "entity", "period", {"v": 0})
    assert sorted(map(tuple, dense.collect())) == [(8, 3, 5, 1), (9, 1, 2, 1), (9, 1, 4, 0), (9, 1, 7, 1), (9, 2, 2, 0), (9, 2, 4, 1), (9, 2, 7, 0)]
    life = joins.life_spine(df, "epoch", "entity", "period")
    assert sorted((r["entity"], r["period"]) for r in life.collect()) == [(1, 2), (1, 4), (1, 7), (2, 4), (3, 5)]
    slots = joins.next_periods(df, "epoch", "period", (1.0, 0.5))
    assert sorted(map(tuple, slots.collect())) == [(8, 5, 0, 5, 1.0), (9, 2, 0, 2, 1.0), (9, 2, 1, 4, 0.5), (9, 4, 0, 4, 1.0), (9, 4, 1, 7, 0.5), (9, 7, 0, 7, 1.0)]


def test_equal_spans_are_counted_each(spark):
    spans = spark.createDataFrame([(1, 2, 4), (1, 2, 4), (2, 1, 1)], "k int, start int, end int")
    events = spark.createDataFrame([(1, 3, "out"), (1, 4, "fit")], "k int, at int, status string")
    out = joins.attach_interval(spans, events, ["k"], "start", "end", "at", "status", ["out"])
    assert sorted((r["k"], r["events"], r["bad_events"]) for r in out.collect()) == [(1, 2, 1), (1, 2, 1), (2, 0, 0)]


def test_pair_dependence_brute_force(spark):
    pdf = crowd()
    got = joins.pair_dependence(spark.createDataFrame(pdf), ["g"], "id", "z", F.col("back")).toPandas().set_index("class")
    lists = {"back": [], "front": [], "mixed": []}
    for _, rows in pdf.sort_values("id").groupby("g"):
        for a, b in itertools.combinations(rows.itertuples(), 2):
            lists["back" if a.back and b.back else "front" if not (a.back or b.back) else "mixed"].append((a.z, b.z))
    for name, pairs in lists.items():
        x = np.array(pairs)
        assert got.loc[name, "pairs"] == len(x)
        assert got.loc[name, "correlation"] == pytest.approx(np.corrcoef(x.T)[0, 1])
        assert got.loc[name, "joint_down"] == pytest.approx(np.mean((x < -0.5).all(1)))
        assert got.loc[name, "joint_up"] == pytest.approx(np.mean((x > 0.5).all(1)))


def test_adjacent_pairs(spark):
    df = spark.createDataFrame([(1, i, s, float(i)) for i, s in enumerate([0, 1, 2, 2, 3])], "g int, id int, side int, z double")
    assert [(r["first"], r["second"]) for r in joins.adjacent_pairs(df, ["g"], "id", "side", "z").collect()] == [(0.0, 1.0)]


def test_profile_before_across_stretches(spark):
    facts = spark.createDataFrame([(1, 5, "a"), (1, 95, "b"), (2, 10, "c")], "k int, t int, v string")
    asks = spark.createDataFrame([(1, 5), (1, 6), (1, 60), (1, 95), (1, 300), (2, 9), (3, 1)], "k int, t int")
    got = {(r["k"], r["t"]): r["v"] for r in joins.profile_before(facts, asks, "k", "t", ["v"], F.floor(F.col("t") / 50)).collect()}
    assert got == {(1, 5): None, (1, 6): "a", (1, 60): "a", (1, 95): "a", (1, 300): "b", (2, 9): None, (3, 1): None}


def test_recover_side(spark):
    rows = [(1, 7, 8, 7), (1, 7, 9, 9), (2, 7, 8, 5), (3, 7, None, 4)]
    df = spark.createDataFrame([(f, p, o, s) for f, p, o, s in rows], "fixture int, period int, opp int, snap int")
    got = [(r["side"], r["recovered"]) for r in joins.recover_side(df, ["fixture", "period"], "opp", "snap").orderBy("fixture", "snap").collect()]
    assert got == [(9, True), (8, True), (5, False), (4, False)]


def test_best_replacement_brute_force(spark):
    rng = np.random.default_rng(8)
    market = pd.DataFrame({
        "period": 1, "entity": np.arange(400), "position": rng.integers(1, 5, 400), "side": rng.integers(0, 7, 400), "price": rng.integers(40, 60, 400),
        "score": np.round(rng.normal(4, 1, 400), 2), "slate": (rng.random(400) > 0.1).astype(int),
    })
    owned = market.nlargest(15, "score").assign(decision=1, sale_price=lambda d: d["price"], bank=2)
    got = joins.best_replacement(
        spark.createDataFrame(owned[["decision", "period", "entity", "position", "side", "sale_price", "bank", "score"]]), spark.createDataFrame(market), "decision", "period"
    ).toPandas().set_index("entity")
    counts = owned["side"].value_counts()
    for o in owned.itertuples():
        ok = market[(market["position"] == o.position) & (market["price"] <= o.sale_price + 2) & (market["slate"] > 0) & ~market["entity"].isin(owned["entity"])]
        ok = ok[(ok["side"] == o.side) | (ok["side"].map(counts).fillna(0) < 3)].sort_values(["score", "entity"], ascending=[False, True])
        if len(ok):
            assert got.loc[o.entity, "replacement"] == ok.iloc[0]["entity"]


def squads(seed, n=40):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        for i, p in enumerate([1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 4, 4, 4]):
            rows.append((d, d * 100 + i, p, float(np.round(rng.normal(4, 2), 2)), int(rng.integers(-1, 15)), int(rng.random() > 0.35) * 90))
    return pd.DataFrame(rows, columns=["decision", "entity", "position", "score", "points", "minutes"])


def test_best_lineup_brute_force(spark):
    pdf = squads(1, 6)
    got = decisions.best_lineup(spark.createDataFrame(pdf), ["decision"], "entity", "position", "score").toPandas()
    for d, rows in pdf.groupby("decision"):
        best = max(
            rows.loc[list(c), "score"].sum() for c in itertools.combinations(rows.index, 11)
            if (lambda q: q[1] == 1 and q[2] >= 3 and q[3] >= 2 and q[4] >= 1)(rows.loc[list(c), "position"].value_counts().reindex([1, 2, 3, 4], fill_value=0))
        )
        mine = got[got["decision"] == d]
        assert mine["in_xi"].sum() == 11 and mine[mine["in_xi"]]["score"].sum() == pytest.approx(best)
        assert mine[mine["captain"]]["score"].iloc[0] == mine[mine["in_xi"]]["score"].max()
        assert mine[mine["bench_order"] == 1]["position"].iloc[0] == 1


def legal(xi, position):
    q = [sum(position[e] == p for e in xi) for p in (1, 2, 3, 4)]
    return len(xi) == 11 and q[0] == 1 and q[1] >= 3 and q[2] >= 2 and q[3] >= 1


def test_realised_value_is_the_sequential_rule(spark):
    lineups = decisions.best_lineup(spark.createDataFrame(squads(4)), ["decision"], "entity", "position", "score")
    got = decisions.realised_value(lineups, ["decision"], "entity", "position", "score", "points", "minutes").toPandas().set_index("decision")
    for d, rows in lineups.toPandas().groupby("decision"):
        by = rows.set_index("entity")
        position, minutes, points = by["position"], by["minutes"], by["points"]
        starters = list(rows[rows["in_xi"]].sort_values(["position", "score", "entity"], ascending=[True, False, True])["entity"])
        bench = list(rows[~rows["in_xi"]].sort_values("bench_order")["entity"])
        final, out = list(starters), [e for e in starters if minutes[e] <= 0]
        missing = len(out)
        for sub in bench:
            if minutes[sub] <= 0:
                continue
            for gone in list(out):
                trial = [sub if e == gone else e for e in final]
                if legal(trial, position):
                    final, _ = trial, out.remove(gone)
                    break
        total = sum(points[e] for e in final if minutes[e] > 0)
        lead = [rows[rows[c]]["entity"].iloc[0] for c in ("captain", "vice")]
        bonus = next((points[e] for e in lead if minutes[e] > 0), 0)
        assert got.loc[d, "normal"] == total + bonus and got.loc[d, "captain_bonus"] == bonus
        assert got.loc[d, "no_shows"] == missing and got.loc[d, "unfilled"] == len(out)
        assert got.loc[d, "all_squad"] == sum(points[e] for e in by.index if minutes[e] > 0) + bonus


def test_regret_is_not_negative(spark):
    out = decisions.path_regret(spark.createDataFrame(squads(9).assign(minutes=90)), ["decision"], "entity", "position", "score", "points", "minutes")
    assert out.where("regret < 0").count() == 0 and out.where("regret > 0").count() > 0


def test_resource_schedule_toy(spark):
    df = spark.createDataFrame([(0, 1, 10.0, 0.0, 1.0), (0, 2, 20.0, 0.0, 9.0)], "w int, t int, bb double, tc double, gain double")
    rows = decisions.resource_schedule(df, ["w"], "t", {"bb": "bb", "tc": "tc"}, {"bb": "gain", "tc": "gain"}, {"bb": 10.0, "tc": 99.0}).collect()
    assert [(r["period"], r["resource"], r["gain"]) for r in rows] == [(1, "bb", 1.0)]


def test_reservation_schedule_is_the_loop(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame([(e, e * 8 + t, *np.round(rng.normal(6, 3, 2), 3), *rng.integers(0, 20, 2)) for e in range(4) for t in range(8)], columns=["epoch", "t", "a", "b", "ga", "gb"])
    got = decisions.reservation_schedule(
        spark.createDataFrame(pdf), ["epoch"], "epoch", "t", {"a": "a", "b": "b"}, {"a": "ga", "b": "gb"}, {"a": 6.0, "b": 8.0}, 0.8
    ).toPandas()
    want = []
    for e, local in pdf.groupby("epoch"):
        unused = {"a", "b"}
        for i, row in enumerate(local.itertuples()):
            left, offers = len(local) - i, []
            must = left <= len(unused)
            for name in sorted(unused):
                past = pdf[pdf["epoch"] < e][name].to_numpy()
                if len(past):
                    bar = np.quantile(past, 0.8 * max(0, (left - len(unused)) / len(local)))
                    spread = max(1.0, past.std())
                else:
                    bar, spread = {"a": 6.0, "b": 8.0}[name], 4.0
                if must or getattr(row, name) >= bar:
                    offers.append(((getattr(row, name) - bar) / spread, name))
            if offers:
                name = max(offers, key=lambda o: o[0])[1]
                want.append((e, row.t, name))
                unused.remove(name)
                if not unused:
                    break
    assert sorted(map(tuple, got[["epoch", "period", "resource"]].itertuples(index=False))) == sorted(want)


def test_first_crossing_fallbacks(spark):
    df = spark.createDataFrame([(1, 1, 3.0, True), (1, 2, 9.0, True), (1, 3, 9.5, True), (2, 1, 1.0, True), (2, 2, 9.0, False), (3, 4, 9.0, False), (3, 5, 1.0, False)], "k int, t int, s double, ok boolean")
    out = decisions.first_crossing(df, ["k"], "t", "s", F.lit(8.0), F.col("ok"), [])
    assert {r["k"]: r["period"] for r in out.collect()} == {1: 2, 2: 1, 3: 5}


def test_doubly_robust(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (5.0, 1.0)], "r double, p double")
    row = aggs.doubly_robust(df, "r", "p", F.lit(1.0), "r", "r").first()
    assert row["value"] == 3.0
    with pytest.raises(Exception, match="propensity"):
        aggs.doubly_robust(df.withColumn("p", F.lit(0.0)), "r", "p", F.lit(1.0), "r", "r").collect()


def test_mass_blank_is_explained_by_few_sides(spark):
    rows = [(1, s, 0, 0) for s in range(12)] + [(1, 20 + s, 1, 1) for s in range(8)]
    out = aggs.mass_blanks(spark.createDataFrame(rows, "period int, side int, slate int, planned int"), ["period"], "side", "slate", "planned").first()
    assert (out["active"], out["explained"]) == (8, True) and out["share"] == pytest.approx(0.6)


def test_quantile_bins_follow_qcut(spark):
    pdf = crowd()
    got = aggs.quantile_bins(spark.createDataFrame(pdf), "f", 5, "bin").toPandas().sort_values("id")["bin"].to_numpy()
    assert (got == pd.qcut(pdf["f"], 5, labels=False, duplicates="drop").to_numpy()).all()


def test_equal_questions_are_matched_once(spark):
    """Ten thousand questions of one name and side meet each known name once, whatever their number; null sides and repeated ids keep their answer."""
    known = spark.createDataFrame([("x", "blue ring", f"b{k}") for k in range(40)] + [("x", "blue rung", "b1")], "t string, name string, brand string")
    asked = spark.range(10_000).selectExpr("'x' as t", "id", "'blue rin' as short", "'b7' as brand")
    odd = spark.createDataFrame([("x", 10_000, "blue ring", None), ("x", 10_001, "zzz", "b1"), ("x", 10_002, "zzz", "b1"), ("x", 10_002, "blue rung", "b1")], "t string, id long, short string, brand string")
    out = joins.best_name_match(asked.unionByName(odd), known, ["t"], "id", "short", "brand", "name", "brand")
    rows = {r.id: (r.match, r.match_side, round(r.score, 6)) for r in out.collect()}
    assert len(rows) == 10_002 and {rows[k] for k in range(10_000)} == {("blue ring", "b7", 1.0)}
    assert rows[10_000] == ("blue ring", "b0", 1.0) and rows[10_002] == ("blue rung", "b1", 1.0)
    plan = out._jdf.queryExecution().toString()
    assert "row_number" not in plan and plan.count("partial_min") >= 1  # no group of a question's candidates reaches one task whole
