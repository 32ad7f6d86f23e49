"""Analytics over decision logs: line-ups, regret, exposure, opportunities and legality.

A decision holds a squad of fifteen and a window holds one row per period, so arrays and windows
over them are short; everything else is a join or an aggregate.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, first_match
from .scale import expanding_quantiles
from .windows import top_k

# Squad quotas, line-up minima by position and legal formations (defence, midfield, attack).
QUOTAS = {1: 2, 2: 5, 3: 5, 4: 3}
LEAST = {1: 1, 2: 3, 3: 2, 4: 1}
FORMATIONS = ((3, 5, 2), (3, 4, 3), (4, 5, 1), (4, 4, 2), (4, 3, 3), (5, 4, 1), (5, 3, 2), (5, 2, 3))


def exposure_weights(df: DataFrame, log: DataFrame, deadline: Sequence[str], stratum: str, entity: str, score: str, near: int = 20) -> DataFrame:
    """Weight of a row in decisions: .2 near the top of its stratum, .5 owned, 1 in the line-up,
    1.5 captain, 1.25 moved. The log holds arrays squad, xi, moved and a captain per deadline."""
    deadline = list(deadline)
    ids = [*deadline, entity]
    top = top_k(df, [*deadline, stratum], [F.desc(score), F.asc(entity)], near, "_r").select(*ids, F.lit(0.20).alias("_w"))

    def listed(column, weight):
        return log.select(*deadline, F.explode(F.array_distinct(column)).alias(entity)).select(*ids, F.lit(weight).alias("_w"))

    parts = top
    for part in (listed(F.col("squad"), 0.5), listed(F.col("xi"), 1.0), listed(F.array("captain"), 1.5), listed(F.col("moved"), 1.25)):
        parts = parts.unionByName(part)
    weights = parts.groupBy(*ids).agg(F.sum("_w").alias("weight"))
    return df.join(weights, ids, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def attribute_errors(predicted: dict[str, Column], actual: dict[str, Column], minutes: Column, expected: Column, play: Column, names: dict[str, str]) -> Column:
    """The route with the largest error, overridden by no-show, reduced and unexpected exposure."""
    errors = F.array(*[
        F.struct(F.abs(predicted[r] - actual[r]).alias("e"), F.lit(-i).alias("i"), F.lit(names[r]).alias("n")) for i, r in enumerate(predicted)
    ])
    largest = F.array_max(errors)["n"]
    return first_match(
        [
            (minutes - expected >= 25, "unexpected minutes"),
            ((minutes <= 0) & (play >= 0.55), "no-show/availability"),
            (expected - minutes >= 25, "reduced minutes/benching"),
        ],
        largest,
    )


def best_lineup(squads: DataFrame, decision: Sequence[str], entity: str, position: str, score: str) -> DataFrame:
    """Mark the best legal eleven, captain, vice and bench order of every squad.

    Each legal formation is valued by sums of the best rows per position in one aggregate; the
    first formation wins ties (totals equal to six decimals). Adds `in_xi`, `captain`, `vice`, `bench_order` and `xi_score`.
    """
    decision = list(decision)
    order = [F.desc(score), F.asc(entity)]
    ranked = squads.withColumn("_rn", F.row_number().over(Window.partitionBy(*decision, position).orderBy(*order)))

    def inside(shape):
        counts = dict(zip((1, 2, 3, 4), (1, *shape)))
        return first_match([(F.col(position) == p, F.col("_rn") <= n) for p, n in counts.items()], False)

    totals = [F.sum(F.when(inside(s), F.col(score)).otherwise(0.0)).alias(f"_t{i}") for i, s in enumerate(FORMATIONS)]
    sizes = [F.count(F.when(inside(s), 1)).alias(f"_n{i}") for i, s in enumerate(FORMATIONS)]
    valued = ranked.groupBy(*decision).agg(*totals, *sizes)
    best = F.array_max(F.array(*[
        F.when(F.col(f"_n{i}") == 11, F.struct(F.round(f"_t{i}", 6).alias("t"), F.lit(-i).alias("i"))) for i in range(len(FORMATIONS))
    ]))
    chosen = valued.select(*decision, best.alias("_best"))
    joined = ranked.join(chosen, decision)
    in_xi = first_match([(F.col("_best")["i"] == -i, inside(s)) for i, s in enumerate(FORMATIONS)], False)
    marked = joined.withColumn("in_xi", F.coalesce(in_xi, F.lit(False))).withColumn("xi_score", F.col("_best")["t"])
    place = F.row_number().over(Window.partitionBy(*decision, "in_xi").orderBy(*order))
    # the reserve keeper stands first on the bench, the rest by score
    bench = F.row_number().over(Window.partitionBy(*decision, "in_xi").orderBy(F.desc(F.col(position) == 1), *order))
    return marked.select(
        *squads.columns, "in_xi", "xi_score", (F.col("in_xi") & (place == 1)).alias("captain"), (F.col("in_xi") & (place == 2)).alias("vice"),
        F.when(~F.col("in_xi"), bench).alias("bench_order"),
    )


def realised_value(lineups: DataFrame, decision: Sequence[str], entity: str, position: str, score: str, points: str, minutes: str) -> DataFrame:
    """Points of each line-up after ordered substitutions and the captain's fallback.

    Bench members who played come in in order, each for the first absent starter that leaves a legal
    eleven. Input from `best_lineup`. A squad becomes one short array; the rule is a fold over its bench.
    """
    decision = list(decision)
    played = F.col(minutes) > 0
    member = F.struct(
        F.col("in_xi").alias("xi"), F.coalesce(F.col("bench_order"), F.lit(0)).alias("b"), F.col(position).alias("p"),
        (-F.col(score)).alias("s"), F.col(entity).alias("e"), F.coalesce(played, F.lit(False)).alias("on"), F.col(points).cast("double").alias("v"),
    )
    squad = lineups.groupBy(*decision).agg(
        F.sort_array(F.collect_list(member)).alias("_m"),
        F.max(F.when(F.col("captain") & played, F.col(points))).alias("_c"), F.max(F.when(F.col("vice") & played, F.col(points))).alias("_v"),
        F.sum(F.when(played, F.col(points)).otherwise(0)).cast("double").alias("_all"),
        F.sum(F.when(F.col("in_xi") & played, F.col(points)).otherwise(0)).cast("double").alias("_xi"),
        F.count(F.when(F.col("in_xi") & ~F.coalesce(played, F.lit(False)), 1)).cast("int").alias("no_shows"),
    )
    # sorting put the bench first (by its order), then the starters by position and score
    bench = F.filter("_m", lambda m: ~m["xi"])
    absent = F.transform(F.filter("_m", lambda m: m["xi"] & ~m["on"]), lambda m: m["p"].cast("int"))

    def held(p):
        return F.size(F.filter("_m", lambda m: m["xi"] & (m["p"] == p)))

    start = F.struct(
        absent.alias("absent"), held(2).alias("n2"), held(3).alias("n3"), held(4).alias("n4"), F.lit(0.0).alias("gain"), F.lit(0).alias("filled"),
    )

    def bring_on(state, sub):
        def fits(q):
            count = F.when(q == 2, state["n2"]).when(q == 3, state["n3"]).otherwise(state["n4"])
            floor = F.when(q == 2, LEAST[2]).when(q == 3, LEAST[3]).otherwise(LEAST[4])
            return (q == sub["p"]) | ((q != 1) & (sub["p"] != 1) & (count - 1 >= floor))

        at = F.array_position(F.transform(state["absent"], fits), F.lit(True)).cast("int")
        out = F.get(state["absent"], at - 1)
        rest = F.concat(F.slice(state["absent"], F.lit(1), at - 1), F.slice(state["absent"], at + 1, F.size(state["absent"])))

        def moved(n, p):
            return state[n] + F.when(sub["p"] == p, 1).otherwise(0) - F.when(out == p, 1).otherwise(0)

        swapped = F.struct(
            rest.alias("absent"), moved("n2", 2).alias("n2"), moved("n3", 3).alias("n3"), moved("n4", 4).alias("n4"),
            (state["gain"] + sub["v"]).alias("gain"), (state["filled"] + 1).alias("filled"),
        )
        return F.when(sub["on"] & (at > 0), swapped).otherwise(state)

    folded = squad.withColumn("_f", F.aggregate(bench, start, bring_on))
    bonus = F.coalesce(F.col("_c"), F.col("_v"), F.lit(0)).cast("double")
    normal = F.col("_xi") + F.col("_f.gain") + bonus
    return folded.select(
        *decision, normal.alias("normal"), (F.col("_all") + bonus).alias("all_squad"), (normal + bonus).alias("triple"), bonus.alias("captain_bonus"),
        "no_shows", F.col("_f.filled").alias("recovered"), (F.col("no_shows") - F.col("_f.filled")).alias("unfilled"),
    )


def captain_bonus(xi: DataFrame, decision: Sequence[str], entity: str, metrics: Sequence[str], points: str, minutes: str) -> DataFrame:
    """Captain, bonus (vice when the captain is absent), regret to the best, and change from the first metric."""
    decision = list(decision)
    played = F.col(minutes) > 0
    base = metrics[0]
    ranks = xi
    for m in metrics:
        order = Window.partitionBy(*decision).orderBy(F.desc(m), F.asc(entity))
        ranks = ranks.withColumn(f"_r_{m}", F.row_number().over(order))

    def at(m, k, value):
        return F.max(F.when((F.col(f"_r_{m}") == k), value))

    on = F.when(played, F.col(points))
    aggs = []
    for m in metrics:
        aggs += [at(m, 1, F.col(entity)).alias(f"c_{m}"), F.coalesce(at(m, 1, on), at(m, 2, on), F.lit(0)).cast("double").alias(f"b_{m}")]
    out = ranks.groupBy(*decision).agg(F.coalesce(F.max(on), F.lit(0)).cast("double").alias("best"), *aggs)
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(f"c_{m}").alias("captain"), F.col(f"b_{m}").alias("bonus"), (F.col("best") - F.col(f"b_{m}")).alias("regret"),
            (F.col(f"b_{m}") - F.col(f"b_{base}")).alias("change"), (F.col(f"c_{m}") != F.col(f"c_{base}")).alias("changed"),
        ) for m in metrics
    ])
    return out.select(*decision, F.explode(rows).alias("_m")).select(*decision, "_m.*")


def captain_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("metric").agg(
        F.avg("bonus").alias("bonus"), F.avg("regret").alias("regret"), F.sum("change").alias("change"),
        F.count(F.when(F.col("changed"), 1)).alias("changed"), F.count(F.when(F.col("changed") & (F.col("change") > 0), 1)).alias("positive"),
        F.count(F.when(F.col("changed") & (F.col("change") < 0), 1)).alias("negative"),
    )


def path_regret(squads: DataFrame, decision: Sequence[str], entity: str, position: str, score: str, points: str, minutes: str) -> DataFrame:
    """Realised value of the chosen line-up, of the best one in hindsight, and what lies between."""
    decision = list(decision)
    args = (decision, entity, position)
    took = realised_value(best_lineup(squads, *args, score), *args, score, points, minutes)
    hindsight = squads.withColumn("_actual", F.col(points).cast("double"))
    best = realised_value(best_lineup(hindsight, *args, "_actual"), *args, "_actual", points, minutes)
    return took.select(*decision, F.col("normal").alias("taken")).join(best.select(*decision, F.col("normal").alias("best")), decision).withColumn(
        "regret", F.col("best") - F.col("taken")
    )


def move_gain(moves: DataFrame, facts: DataFrame, decision: str, period: str, entity: str, points: str, periods: int = 6) -> DataFrame:
    """Points of the entities brought in less those sent out over the next periods.

    moves: (decision, period, in_entities, out_entities); the span is laid out, so this is an equi-join.
    """
    def sided(column, sign):
        return moves.select(decision, F.col(period).alias("_from"), F.explode(column).alias(entity), F.lit(sign).alias("_sign"))

    sides = sided("in_entities", 1).unionByName(sided("out_entities", -1))
    laid = sides.withColumn(period, F.explode(F.sequence(F.col("_from"), F.col("_from") + periods - 1)))
    hit = laid.join(facts.select(period, entity, F.col(points).alias("_v")), [period, entity], "left")
    return hit.groupBy(decision).agg(F.coalesce(F.sum(F.col("_v") * F.col("_sign")), F.lit(0)).alias("gain"))


def exposure_rates(facts: DataFrame, log: DataFrame, deadline: Sequence[str], entity: str, points: str, rank: str) -> DataFrame:
    """Share of periods an entity was held, fielded and captained, points while left out, mean rank."""
    deadline = list(deadline)
    ids = [*deadline, entity]
    owned = log.select(*deadline, F.explode("squad").alias(entity), "xi", "captain").select(
        *ids, F.lit(1).alias("_own"), F.array_contains("xi", F.col(entity)).alias("_xi"), (F.col("captain") == F.col(entity)).alias("_cap")
    )
    joined = facts.join(owned, ids, "left")

    def share(test):
        return F.avg(F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0))

    out = F.col("_own").isNull()
    return joined.groupBy(entity).agg(
        F.sum(points).alias("total"), share(~out).alias("squad_rate"), share(F.col("_xi")).alias("xi_rate"), share(F.col("_cap")).alias("captain_rate"),
        F.sum(F.when(out, F.col(points)).otherwise(0)).alias("omitted"), F.avg(rank).alias("mean_rank"),
    )


def opportunity_frame(rows: DataFrame, windows: DataFrame, epoch: str, period: str) -> DataFrame:
    """Place each period in its window: index, length and progress. windows: (epoch, start, end), a few per epoch."""
    inside = rows.join(windows, epoch).where((F.col(period) >= F.col("start")) & (F.col(period) <= F.col("end")))
    part = Window.partitionBy(epoch, "start")
    index = F.row_number().over(part.orderBy(period)) - 1
    length = F.count(F.lit(1)).over(part)
    placed = inside.withColumn("index", index).withColumn("length", length)
    return placed.withColumn("progress", F.col("index") / F.greatest(F.col("length") - 1, F.lit(1)))


def first_crossing(rows: DataFrame, keys: Sequence[str], period: str, signal: str, threshold: Column, structural: Column, values: Sequence[str]) -> DataFrame:
    """The first structural period at the threshold, else the last structural one, else the last."""
    pick = F.struct(F.col(period).alias("period"), *[F.col(v) for v in (signal, *values)])
    crossed = structural & (F.col(signal) >= threshold)
    chosen = F.coalesce(
        F.min_by(pick, F.when(crossed, F.col(period))), F.max_by(pick, F.when(structural, F.col(period))), F.max_by(pick, F.col(period))
    )
    return rows.groupBy(*keys).agg(chosen.alias("_p"), F.coalesce(F.max(crossed), F.lit(False)).alias("crossed")).select(*keys, "_p.*", "crossed")


def expanding_threshold(rows: DataFrame, epoch: str, signal: str, structural: Column, quantile: float, default: float) -> DataFrame:
    """Per epoch the quantile of all earlier structural signals; the default where there are none."""
    asks = rows.select(epoch).distinct().withColumn("q", F.lit(float(quantile)))
    known = expanding_quantiles(rows.where(structural), [], epoch, signal, asks, "threshold")
    return known.select(epoch, F.coalesce("threshold", F.lit(default)).alias("threshold"))


def resource_schedule(rows: DataFrame, keys: Sequence[str], period: str, signals: dict[str, str], gains: dict[str, str], thresholds: dict[str, float]) -> DataFrame:
    """First-crossing use of several resources: each once per window, one per period, largest excess first.

    A window is one short array of periods; the rule is a fold over it.
    """
    names = sorted(signals)
    row = F.struct(F.col(period).alias("t"), F.array(*[F.col(signals[n]).cast("double") for n in names]).alias("s"), F.array(*[F.col(gains[n]).cast("double") for n in names]).alias("g"))
    window = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_w"))
    bars = [float(thresholds[n]) for n in names]
    start = F.struct(F.array(*[F.lit(False)] * len(names)).alias("used"), F.array().cast("array<struct<period: int, resource: string, signal: double, gain: double>>").alias("picks"))

    def step(state, now):
        offers = F.array(*[
            F.when(
                ~state["used"][i] & (now["s"][i] >= bars[i]),
                F.struct((now["s"][i] - bars[i]).alias("x"), now["s"][i].alias("s"), F.lit(n).alias("n"), now["g"][i].alias("g"), F.lit(i).alias("i")),
            ) for i, n in enumerate(names)
        ])
        best = F.array_max(offers)
        pick = F.struct(now["t"].cast("int").alias("period"), best["n"].alias("resource"), best["s"].alias("signal"), best["g"].alias("gain"))
        used = F.array(*[state["used"][i] | (best["i"] == i) for i in range(len(names))])
        return F.when(best.isNull(), state).otherwise(F.struct(used.alias("used"), F.concat(state["picks"], F.array(pick)).alias("picks")))

    return window.select(*keys, F.explode(F.aggregate("_w", start, step)["picks"]).alias("_p")).select(*keys, "_p.*")


def reservation_schedule(
    rows: DataFrame, keys: Sequence[str], epoch: str, period: str, scores: dict[str, str], gains: dict[str, str], defaults: dict[str, float], quantile: float,
) -> DataFrame:
    """Use each resource once per window against a reservation quantile of earlier epochs that decays to
    zero towards expiry; when as few periods as resources remain the most urgent is forced.

    The bars a window may meet (one per period and number of unused resources) are read off together, as quantiles of all earlier epochs.
    """
    names = sorted(scores)
    place = Window.partitionBy(*keys).orderBy(period)
    counted = rows.withColumn("_i", F.row_number().over(place) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # at a period the bar depends on how many resources are unused: a quantile of earlier scores for each such number
    shares = [quantile * F.greatest((F.col("_n") - F.col("_i") - m) / F.greatest(F.col("_n"), F.lit(1)), F.lit(0.0)) for m in range(1, len(names) + 1)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_name"), (share).alias("q")) for i in range(len(names)) for share in shares]))
    asks = counted.select(epoch, each.alias("_e")).select(epoch, "_e._name", "_e.q").distinct()
    seen = rows.select(epoch, F.explode(F.array(*[F.struct(F.lit(i).alias("_name"), F.col(scores[n]).cast("double").alias("_score")) for i, n in enumerate(names)])).alias("_e")).select(epoch, "_e.*")
    bars = expanding_quantiles(seen, ["_name"], epoch, "_score", asks, "_bar").groupBy(epoch).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("_name", "q").alias("k"), F.col("_bar").alias("v")))).alias("_bars"))
    earlier = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)  # a row per epoch
    sums = rows.groupBy(epoch).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(F.col(scores[n]).cast("double")).alias(f"_s{i}") for i, n in enumerate(names)],
                                   *[F.sum(F.pow(F.col(scores[n]).cast("double"), 2)).alias(f"_ss{i}") for i, n in enumerate(names)])
    c = F.sum("_c").over(earlier)
    spread = [F.sqrt(F.greatest(F.sum(f"_ss{i}").over(earlier) / c - F.pow(F.sum(f"_s{i}").over(earlier) / c, 2), F.lit(0.0))).alias(f"_d{i}") for i in range(len(names))]
    prior = sums.select(epoch, *spread)
    mine = [F.array(*[F.element_at("_bars", F.struct(F.lit(i).alias("_name"), share.alias("q"))) for share in shares]) for i in range(len(names))]
    counted = counted.join(bars, epoch).withColumn("_b", F.array(*mine)).drop("_bars")
    row = F.struct(F.col(period).alias("t"), F.array(*[F.col(scores[n]).cast("double") for n in names]).alias("s"), F.array(*[F.col(gains[n]).cast("double") for n in names]).alias("g"), F.col("_b").alias("b"))
    window = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_w")).join(prior, epoch, "left").withColumn("_n", F.size("_w"))
    shape = "array<struct<period: int, resource: string, score: double, reservation: double, gain: double, forced: boolean>>"
    start = F.struct(F.array(*[F.lit(False)] * len(names)).alias("used"), F.lit(0).alias("at"), F.array().cast(shape).alias("picks"))

    def step(state, now):
        unused = F.size(F.filter(state["used"], lambda u: ~u))
        remaining = F.col("_n") - state["at"]
        must = remaining <= unused
        offers = []
        for i, n in enumerate(names):
            known = F.get(now["b"][i], unused - 1)
            bar = F.coalesce(known, F.lit(float(defaults[n])))
            scale = F.when(known.isNotNull(), F.greatest(F.lit(1.0), F.col(f"_d{i}"))).otherwise(F.lit(4.0))
            score = now["s"][i]
            offers.append(F.when(
                ~state["used"][i] & (must | (score >= bar)),
                F.struct(((score - bar) / scale).alias("u"), F.lit(-i).alias("i"), F.lit(n).alias("n"), score.alias("s"), bar.alias("b"), now["g"][i].alias("g")),
            ))
        best = F.array_max(F.array(*offers))
        pick = F.struct(
            now["t"].cast("int").alias("period"), best["n"].alias("resource"), best["s"].alias("score"), best["b"].alias("reservation"),
            best["g"].alias("gain"), (must & (best["s"] < best["b"])).alias("forced"),
        )
        used = F.array(*[state["used"][i] | (best["i"] == -i) for i in range(len(names))])
        after = state["at"] + 1
        return F.when(best.isNull(), F.struct(state["used"].alias("used"), after.alias("at"), state["picks"].alias("picks"))).otherwise(
            F.struct(used.alias("used"), after.alias("at"), F.concat(state["picks"], F.array(pick)).alias("picks"))
        )

    return window.select(*keys, F.explode(F.aggregate("_w", start, step)["picks"]).alias("_p")).select(*keys, "_p.*")


def best_in_window(rows: DataFrame, keys: Sequence[str], period: str, value: str, structural: Column) -> DataFrame:
    """The best period of a window, and the best structural one (earliest on ties)."""
    order = F.struct(F.col(value), -F.col(period))
    best = F.max_by(F.col(period), order)
    solid = F.max_by(F.col(period), F.when(structural, order))
    return rows.groupBy(*keys).agg(
        best.alias("best_period"), F.max(value).alias("best_value"), solid.alias("structural_period"), F.max(F.when(structural, F.col(value))).alias("structural_value")
    )


def best_distinct_pair(rows: DataFrame, keys: Sequence[str], period: str, first: str, second: str) -> DataFrame:
    """Best sum of two values taken in different periods: only the two best of each can matter."""
    def two(value):
        top = top_k(rows, keys, [F.desc(value), F.asc(period)], 2, "_r")
        return top.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == i, F.struct(F.col(value).alias("v"), F.col(period).alias("t")))).alias(f"_{value}{i}") for i in (1, 2)])

    joined = two(first).join(two(second), list(keys))
    pairs = F.array(*[
        F.when(
            F.col(f"_{first}{i}")["t"] != F.col(f"_{second}{k}")["t"],
            F.struct((F.col(f"_{first}{i}")["v"] + F.col(f"_{second}{k}")["v"]).alias("v"), (-F.col(f"_{first}{i}")["t"]).alias("a"), (-F.col(f"_{second}{k}")["t"]).alias("b")),
        ) for i in (1, 2) for k in (1, 2)
    ])
    best = F.array_max(pairs)
    return joined.select(*keys, best["v"].alias("value"), (-best["a"]).alias("first_period"), (-best["b"]).alias("second_period"))


def risk_proxy(kind: str, uncertainty, play=None, blanks=None) -> Column:
    """Risk of playing a single (captain) or a bench resource."""
    if kind == "captain":
        return col(uncertainty) * (1.15 - 0.35 * col(play))
    return col(uncertainty) + 1.5 * col(blanks)


def hurdle(value, risk, penalty: float) -> Column:
    return col(value) - penalty * col(risk)


def availability_summary(starters: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starters below the floors and absent, and substitutions made and missed.

    starters: one row per fielded entity (start, play, minutes); values: from `realised_value`.
    """
    low = (F.col("start") < 0.70) | (F.col("play") < 0.84)
    rows = starters.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("starters"), F.avg(F.when(low, 1.0).otherwise(0.0)).alias("below_floor"),
        F.count(F.when(F.col("play") < 0.70, 1)).alias("severe"), F.avg(F.when(F.col("minutes") <= 0, 1.0).otherwise(0.0)).alias("no_show_rate"),
    )
    weeks = values.groupBy(*keys).agg(
        F.count(F.when(F.col("no_shows") > 0, 1)).alias("weeks_with_no_show"), F.sum("recovered").alias("recovered"), F.sum("unfilled").alias("unfilled")
    )
    return rows.join(weeks, list(keys))


def variant_comparison(totals: DataFrame, variant: str, epoch: str, value: str, base: str) -> DataFrame:
    """Each variant's value and difference from the base, epoch by epoch."""
    reference = totals.where(F.col(variant) == base).select(epoch, F.col(value).alias("_base"))
    return totals.join(reference, epoch, "left").select(variant, epoch, F.col(value).alias("value"), (F.col(value) - F.col("_base")).alias("delta"))


def fieldability(squads: DataFrame, decision: Sequence[str], play: str, out: Column, slate: str, in_xi: str) -> DataFrame:
    """Expected appearances of squad and line-up, members who are out, and members with a slate."""
    chance = F.when(out, F.lit(0.0)).otherwise(F.col(play))
    xi = F.col(in_xi)
    return squads.groupBy(*decision).agg(
        F.sum(chance).alias("expected_squad"), F.sum(F.when(xi, chance).otherwise(0.0)).alias("expected_xi"), F.avg(F.when(xi, chance)).alias("mean_xi"),
        F.count(F.when(xi & out, 1)).alias("out_in_xi"), F.count(F.when(F.col(slate) > 0, 1)).alias("squad_with_slate"),
        F.count(F.when(xi & (F.col(slate) > 0), 1)).alias("xi_with_slate"),
    )


def legality(squads: DataFrame, decision: Sequence[str], entity: str, position: str, side: str, price: str, budget: Column, side_cap: int = 3) -> DataFrame:
    """Size, quotas, side limit and budget of each squad; `legal` when all hold."""
    decision = list(decision)
    per_side = squads.groupBy(*decision, side).agg(F.count(F.lit(1)).alias("_n")).groupBy(*decision).agg(F.max("_n").alias("largest_side"))
    counts = squads.groupBy(*decision).agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct(F.col(entity)).alias("_distinct"), F.sum(price).alias("cost"), F.max(budget).alias("_budget"),
        *[F.count(F.when(F.col(position) == p, 1)).alias(f"_q{p}") for p in QUOTAS],
    )
    quota = F.lit(True)
    for p, n in QUOTAS.items():
        quota = quota & (F.col(f"_q{p}") == n)
    joined = counts.join(per_side, decision)
    affordable = F.col("cost") <= F.col("_budget")
    size_ok = (F.col("size") == 15) & (F.col("_distinct") == 15)
    return joined.select(
        *decision, "size", "cost", "largest_side", quota.alias("quotas"), affordable.alias("affordable"),
        (size_ok & quota & affordable & (F.col("largest_side") <= side_cap)).alias("legal"),
    )


def affordability(holdings: DataFrame, decision: Sequence[str], sale: Column, bank: Column) -> DataFrame:
    """Bank plus resale value of the holdings, in whole tenths."""
    return holdings.groupBy(*decision).agg((F.sum(sale) + F.max(bank)).alias("budget"))


def classification_audit(df: DataFrame, probability: str, outcome: Column, masks: dict[str, Column]) -> DataFrame:
    """Positive rate, accuracy at one half, majority accuracy and Brier score, for all and per mask."""
    tags = F.array_compact(F.array(F.lit("all"), *[F.when(test, F.lit(n)) for n, test in masks.items()]))
    rows = df.select(F.col(probability).alias("_p"), outcome.alias("_y"), F.explode(tags).alias("segment"))
    y = F.when(F.col("_y"), 1.0).otherwise(0.0)
    right = F.when((F.col("_p") >= 0.5) == F.col("_y"), 1.0).otherwise(0.0)
    gap = F.col("_p") - y
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("positive_rate"), F.avg(right).alias("accuracy"),
        F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"), F.avg(gap * gap).alias("brier"),
    )
