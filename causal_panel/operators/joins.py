"""Joins over panels: roles, spines, as-of lookups, intervals, names and replacements."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markets import blend_sources, fit_goal_rates, market_weight
from ..functions.names import name_key
from .scale import ordered_prefix, ordinal_rank
from .windows import timeline, top_k

# Weight of this and the next five observed periods.
HORIZON_WEIGHTS = (1.0, 0.86, 0.74, 0.64, 0.55, 0.47)


def attach_dimension(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join; the physical join is chosen at run time from the measured sizes."""
    return facts.join(dimension, list(keys), "left")


def two_roles(df: DataFrame, side: DataFrame, shared: Sequence[str], own: str, other: str, key: str) -> DataFrame:
    """The same side table under two roles: columns become own_* and opp_*."""
    out = df
    for prefix, role in (("own", own), ("opp", other)):
        named = side.select(
            *shared, F.col(key).alias(f"_{prefix}"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in side.columns if c not in (*shared, key)],
        )
        out = out.withColumn(f"_{prefix}", F.col(role)).join(named, [*shared, f"_{prefix}"], "left").drop(f"_{prefix}")
    return out


def recover_side(df: DataFrame, fixture: Sequence[str], opponent: str, snapshot: str) -> DataFrame:
    """The side that played: the one opponent in the fixture that is not this row's opponent.

    Adds `side`, `recovered` (differs from the snapshot) and `resolved` (two sides seen).
    """
    known = df.where(F.col(opponent).isNotNull())
    for c in fixture:
        known = known.where(F.col(c).isNotNull())
    # a fixture has two sides; three are enough to tell that it is broken
    sides = known.groupBy(*fixture).agg(
        F.min(opponent).alias("_a"), F.max(opponent).alias("_b"), F.count_distinct(opponent).alias("_n")
    )
    joined = df.join(sides, list(fixture), "left")
    other = F.when(F.col(opponent) == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))
    sure = (F.col("_n") == 2) & F.col(opponent).isNotNull()
    side = F.when(sure, other).otherwise(F.col(snapshot))
    return (
        joined.withColumn("side", side)
        .withColumn("recovered", F.coalesce(F.col("side") != F.col(snapshot), F.lit(False)))
        .withColumn("resolved", F.coalesce(F.col("_n") == 2, F.lit(False)))
        .drop("_a", "_b", "_n")
    )


# Parts into which the entities of an epoch are dealt, so that one epoch is not one task.
SPREAD = 64


def _by_period(df: DataFrame, epoch: str, entities: DataFrame, entity: str, period: str) -> DataFrame:
    """`entities` with every period observed in their epoch: an equi-join on the epoch and a part of its entities."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part")
    calendar = df.select(epoch, period).distinct().select(epoch, period, parts)
    return entities.withColumn("_part", F.pmod(F.hash(entity), F.lit(SPREAD))).join(calendar, [epoch, "_part"]).drop("_part")


def dense_spine(df: DataFrame, epoch: str, entity: str, period: str, fills: dict[str, object]) -> DataFrame:
    """Every entity of an epoch in every period observed in that epoch, gaps filled."""
    spine = _by_period(df, epoch, df.select(epoch, entity).distinct(), entity, period).select(epoch, entity, period)
    out = spine.join(df, [epoch, entity, period], "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c) for c in out.columns])


def life_spine(df: DataFrame, epoch: str, entity: str, period: str) -> DataFrame:
    """Every observed period between an entity's first and last; the rest of the row may be null."""
    life = df.groupBy(epoch, entity).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    inside = F.col(period).between(F.col("_first"), F.col("_last"))
    spine = _by_period(df, epoch, life, entity, period).where(inside).select(epoch, entity, period)
    return spine.join(df, [epoch, entity, period], "left")


def latest_profile(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each key by order."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def profile_before(
    df: DataFrame, asks: DataFrame, key: str, at: str, columns: Sequence[str], stretch: Column
) -> DataFrame:
    """For each (key, at) asked, the last profile strictly before it (null when none).

    Profiles and questions are merged into one timeline, so no range join is needed. `stretch` is
    a coarse, non-decreasing function of `at` (its month, say): each stretch of a key is scanned on
    its own and the last profile of earlier stretches is carried in, so a busy key is split.
    """
    facts = df.select(key, at, F.struct(*columns).alias("_profile"), F.lit(1).alias("_kind"))
    empty = F.lit(None).cast(facts.schema["_profile"].dataType)
    wanted = asks.select(key, at, empty.alias("_profile"), F.lit(0).alias("_kind"))
    merged = facts.unionByName(wanted).withColumn("_stretch", stretch)
    lasts = facts.withColumn("_stretch", stretch).groupBy(key, "_stretch").agg(F.max_by("_profile", at).alias("_end"))
    stretches = asks.select(key, stretch.alias("_stretch")).distinct().join(lasts, [key, "_stretch"], "full")
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(key, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    # questions sort before profiles of the same instant: strictly earlier only
    inside = Window.partitionBy(key, "_stretch").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = merged.withColumn("_seen", F.last("_profile", ignorenulls=True).over(inside)).where(F.col("_kind") == 0)
    out = seen.join(carried, [key, "_stretch"], "left").withColumn("_last", F.coalesce("_seen", "_carried"))
    return out.select(key, at, *[F.col("_last")[c].alias(c) for c in columns])


def attach_covered(df: DataFrame, source: DataFrame, keys: Sequence[str], single: Column, values: dict[str, str]) -> DataFrame:
    """Source values where the key matches and the slate is single, else the baseline column.

    `values` maps a source column to its baseline column; adds `new_<source>` and `covered`.
    """
    found = source.dropDuplicates(list(keys)).select(*keys, *values, F.lit(True).alias("_hit"))
    joined = df.join(found, list(keys), "left")
    covered = F.coalesce(F.col("_hit") & single, F.lit(False))
    outs = [F.when(covered, F.col(s)).otherwise(F.col(b)).alias(f"new_{s}") for s, b in values.items()]
    return joined.select(*df.columns, *outs, covered.alias("covered"))


def newcomers(df: DataFrame, epoch: str, side: str) -> DataFrame:
    """(epoch, side) present now and absent from the epoch before; never in the first epoch."""
    now = df.select(epoch, side).distinct()
    before = now.select((F.col(epoch) + 1).alias(epoch), side)
    return now.where(F.col(epoch) > 0).join(before, [epoch, side], "left_anti")


def _cells(low: Column, high: Column, levels: int) -> Column:
    """(l, c) cells, c counting runs of 2^l whole numbers, that together are low..high."""
    low, high, parts = low.cast("int"), high.cast("int"), []
    for k in range(levels):
        left = F.when((low <= high) & (low % 2 != 0), F.struct(F.lit(k).alias("l"), low.alias("c")))
        right = F.when((low <= high) & (high % 2 == 0), F.struct(F.lit(k).alias("l"), high.alias("c")))
        parts += [left, right]
        low, high = F.shiftright(low + 1, 1), F.shiftright(high - 1, 1)
    rest = F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda c: F.struct(F.lit(levels).alias("l"), c.alias("c")))
    return F.concat(F.array_compact(F.array(*parts)), rest) if parts else rest


def near_price_pairs(df: DataFrame, keys: Sequence[str], price: str, forecast: str, outcome: str, band: int = 15) -> DataFrame:
    """Per group: pairs with prices within the band and different outcomes, and how many the forecast orders.

    `price` is in whole tenths. No pair is formed. Outcomes are numbered in their group; a pair with numbers a < b has one highest
    bit where they part, so each row asks, per such bit, how many rows with the lower number in the band also have a lower
    forecast; the answers are running counts over the forecast. The band is put together from runs of 2^l prices, so a row
    is laid out a few times per bit: once per run length where it answers, once per run of its band where it asks.
    """
    keys, levels = list(keys), (2 * band + 1).bit_length() - 2 if band else 0
    used = df.where(F.col(outcome).isNotNull() & F.col(forecast).isNotNull() & F.col(price).isNotNull()).select(
        *keys, F.col(price).cast("int").alias("_p"), F.col(outcome).cast("double").alias("_o"), F.col(forecast).cast("double").alias("_f"))
    # one row per different outcome of a group, however many rows have it
    different, whole = used.select(*keys, "_o").distinct(), Window.partitionBy(*keys)
    numbered = different.select(
        *keys, "_o", (F.row_number().over(whole.orderBy("_o")) - 1).alias("_a"), F.count(F.lit(1)).over(whole).alias("_outcomes"))
    numbered = numbered.where(F.col("_outcomes") > 1).select(*keys, "_o", "_a", F.length(F.bin(F.col("_outcomes") - 1)).alias("_bits"))
    rows = used.groupBy(*keys, "_p", "_o", "_f").agg(F.count(F.lit(1)).alias("_n")).join(numbered, [*keys, "_o"])
    halves = rows.select(*keys, "_p", "_f", "_a", "_n", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("_b")).withColumn(
        "_h", F.expr("shiftright(_a, _b)")
    )
    none = F.lit(0).cast("bigint")
    runs = F.array(*[F.struct(F.lit(k).alias("l"), F.shiftright("_p", k).alias("c")) for k in range(levels + 1)])
    low = halves.where(F.col("_h") % 2 == 0).select(*keys, "_f", "_b", "_h", F.col("_n").alias("_in"), none.alias("_q"), F.explode(runs).alias("_c"))
    band_runs = F.explode(_cells(F.col("_p") - band, F.col("_p") + band, levels))
    high = halves.where(F.col("_h") % 2 == 1).select(*keys, "_f", "_b", (F.col("_h") - 1).alias("_h"), none.alias("_in"), F.col("_n").alias("_q"), band_runs.alias("_c"))
    laid = low.unionByName(high).select("*", "_c.l", "_c.c").drop("_c").withColumnsRenamed({"l": "_l", "c": "_c"})
    counted = ordered_prefix(laid, [*keys, "_l", "_c", "_b", "_h"], "_f", {"ins": F.sum("_in"), "ask": F.sum("_q")})
    return counted.groupBy(*keys).agg(
        F.sum(F.col("ask") * F.col("ins_total")).alias("pairs"),
        F.sum(F.col("ask") * F.col("ins_before")).alias("ordered"),
    ).where(F.col("pairs") > 0)


def pair_dependence(df: DataFrame, keys: Sequence[str], entity: str, value: str, back: Column) -> DataFrame:
    """Dependence of a value over the unordered pairs of a group, by class of the pair.

    A pair is (smaller entity, larger entity). Counts of later and earlier members give each row's
    part in the pair sums, so pairs, correlation and joint tail rates come without forming pairs.
    """
    keys = list(keys)
    z = F.col(value)
    rows = df.where(z.isNotNull()).select(*keys, entity, z.alias("_z"), back.alias("_back"))
    is_back = F.col("_back")

    def tally(test):
        return F.count(F.when(test, 1))

    def members(flag):
        return {
            "n": tally(flag), "z": F.sum(F.when(flag, F.col("_z")).otherwise(0.0)),
            "lo": tally(flag & (F.col("_z") < -0.5)), "hi": tally(flag & (F.col("_z") > 0.5)),
        }

    sums = {f"b_{k}": v for k, v in members(is_back).items()} | {f"f_{k}": v for k, v in members(~is_back).items()}
    prefix = ordered_prefix(rows, keys, entity, sums)
    seen = rows.join(prefix, [*keys, entity])

    def part(label: str, theirs: str) -> Column:
        later = F.col(f"{theirs}_n_total") - F.col(f"{theirs}_n_before") - F.col(f"{theirs}_n")
        return F.struct(
            F.lit(label).alias("class"), later.alias("left_n"), F.col(f"{theirs}_n_before").alias("right_n"), F.col("_z"),
            (F.col("_z") * F.col(f"{theirs}_z_before")).alias("product"),
            F.when(F.col("_z") < -0.5, F.col(f"{theirs}_lo_before")).otherwise(0).alias("down"),
            F.when(F.col("_z") > 0.5, F.col(f"{theirs}_hi_before")).otherwise(0).alias("up"),
        )

    # a row has a part in the pairs of its own class and in the mixed ones; one pass gives both
    own = F.when(is_back, F.array(part("back", "b"), part("mixed", "f"))).when(~is_back, F.array(part("front", "f"), part("mixed", "b")))
    merged = seen.select(F.explode(own).alias("_part")).select("_part.*")
    n, z = F.col("pairs"), F.col("_z")
    total = merged.groupBy("class").agg(
        F.sum("right_n").alias("pairs"), F.sum(F.col("left_n") * z).alias("sl"), F.sum(F.col("right_n") * z).alias("sr"),
        F.sum(F.col("left_n") * z * z).alias("sll"), F.sum(F.col("right_n") * z * z).alias("srr"),
        F.sum("product").alias("slr"), F.sum("down").alias("down"), F.sum("up").alias("up"),
    ).where(n > 0)
    spread = F.sqrt((n * F.col("sll") - F.col("sl") * F.col("sl")) * (n * F.col("srr") - F.col("sr") * F.col("sr")))
    return total.select(
        "class", "pairs", F.try_divide(n * F.col("slr") - F.col("sl") * F.col("sr"), spread).alias("correlation"),
        (F.col("down") / n).alias("joint_down"), (F.col("up") / n).alias("joint_up"),
    )


def adjacent_pairs(df: DataFrame, keys: Sequence[str], order: str, side: str, value: str) -> DataFrame:
    """Rows 2k and 2k+1 of each group in order, as one row, where the sides differ."""
    ranked = ordinal_rank(df, keys, order, order, "_rn")
    pair = ranked.groupBy(*keys, F.expr("(_rn - 1) div 2").alias("pair")).agg(
        F.min_by(value, "_rn").alias("first"), F.max_by(value, "_rn").alias("second"),
        F.min_by(side, "_rn").alias("_s1"), F.max_by(side, "_rn").alias("_s2"), F.count(F.lit(1)).alias("_n"),
    )
    return pair.where((F.col("_n") == 2) & (F.col("_s1") != F.col("_s2"))).drop("_s1", "_s2", "_n")


def next_periods(df: DataFrame, epoch: str, period: str, weights: Sequence[float] = HORIZON_WEIGHTS) -> DataFrame:
    """(epoch, period, slot, target, weight) for the next observed periods of the epoch.

    Periods are numbered within their epoch, and a slot ahead is an equi-join on the number.
    """
    calendar = df.select(epoch, period).distinct().withColumn("_i", F.row_number().over(timeline(epoch, period)))
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(w).alias("weight")) for i, w in enumerate(weights)]))
    asked = calendar.select(epoch, period, "_i", slots.alias("_s")).select(epoch, period, "_s.*", (F.col("_i") + F.col("_s.slot")).alias("_i"))
    return asked.join(calendar.select(epoch, F.col(period).alias("target"), "_i"), [epoch, "_i"]).select(epoch, period, "slot", "target", "weight")


def forward_slate(
    base: DataFrame, schedule: DataFrame, strength: DataFrame, fallback: DataFrame, home_bonus: float = 0.18
) -> DataFrame:
    """Weighted strength of the next fixtures of a side, each as known in the base period.

    base: (epoch, period, side, position); schedule: (epoch, period, side, opponent, is_home);
    strength: (epoch, period, position, opponent, strength); fallback: (epoch, period, position, neutral).
    `outlook` uses the whole slate; `censored` knows the current slot only and is neutral after it.
    """
    slots = next_periods(schedule, "epoch", "period")
    games = schedule.select("epoch", F.col("period").alias("target"), "side", "opponent", "is_home")
    known = base.join(fallback, ["epoch", "period", "position"], "left").withColumn("neutral", F.coalesce("neutral", F.lit(2.5)))
    slotted = known.join(slots, ["epoch", "period"])
    timed = slotted.join(games, ["epoch", "target", "side"], "left")
    valued = timed.join(strength, ["epoch", "period", "position", "opponent"], "left")
    value = F.coalesce(F.col("strength"), F.col("neutral")) + F.when(F.col("is_home"), home_bonus).otherwise(0.0)
    played = F.col("opponent").isNotNull()
    now = F.col("slot") == 0
    keys = ["epoch", "period", "side", "position"]
    # later slots count once each in the censored view, however many fixtures they hold
    per_slot = valued.groupBy(*keys, "neutral", "slot", "weight").agg(
        F.sum(F.when(played, value)).alias("_v"), F.count(F.when(played, 1)).alias("_n")
    )
    w, n, v = F.col("weight"), F.col("_n"), F.coalesce(F.col("_v"), F.lit(0.0))
    late_weight = F.sum(F.when(~now, w).otherwise(0.0))
    summed = per_slot.groupBy(*keys, "neutral").agg(
        F.sum(w * v).alias("_wv"), F.sum(w * n).alias("_wn"), F.sum(F.when(now, v).otherwise(0.0)).alias("_v0"),
        F.sum(F.when(now, n).otherwise(0)).alias("_n0"), late_weight.alias("_wl"),
    )
    neutral = F.col("neutral")
    return summed.select(
        *keys,
        F.when(F.col("_wn") > 0, F.col("_wv") / F.col("_wn")).otherwise(neutral).alias("outlook"),
        F.greatest(F.col("_wn"), F.lit(1.0)).alias("games"),
        F.when(F.col("_n0") + F.col("_wl") > 0, (F.col("_v0") + F.col("_wl") * neutral) / (F.col("_n0") + F.col("_wl")))
        .otherwise(neutral).alias("censored"),
        (F.col("_n0") + F.col("_wl")).alias("games_censored"),
    )


def attach_interval(spans: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, at: str, status: str, bad: Sequence[str]) -> DataFrame:
    """Events of the same key inside [start, end]: how many, and whether any has a listed status.

    Spans are laid out period by period, so this is an equi-join.
    """
    once = spans.groupBy(*spans.columns).agg(F.count(F.lit(1)).alias("_copies"))  # equal spans are counted each
    days = once.select("*", F.explode(F.sequence(start, end)).alias("_at"))
    hits = days.join(events.select(*keys, F.col(at).alias("_at"), status), [*keys, "_at"], "left")
    flag = F.coalesce(F.col(status).isin(*bad), F.lit(False))
    counted = hits.groupBy(*spans.columns, "_copies").agg(
        F.count(status).alias("events"), F.count(F.when(flag, 1)).alias("bad_events"), F.max(flag).alias("explained")
    )
    return counted.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")


def name_similarity(short: Column, full: Column) -> Column:
    """1 when equal, .94 when contained, .92 for initial plus ending, else 1 - edit distance / longer length."""
    tail = F.substr(short, F.lit(2))
    initial = (F.length(short) >= 4) & F.endswith(full, tail) & (F.substring(short, 1, 1) == F.substring(full, 1, 1))
    ratio = 1 - F.levenshtein(short, full) / F.greatest(F.length(short), F.length(full))
    return (
        F.when((short == "") | (full == ""), F.lit(0.0)).when(short == full, F.lit(1.0))
        .when(F.contains(full, short), F.lit(0.94)).when(initial, F.lit(0.92)).otherwise(ratio)
    )


def _grams(key: Column) -> Column:
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(padded, i, F.lit(2))))


def best_name_match(
    asked: DataFrame, known: DataFrame, block: Sequence[str], ask_id: str, ask_name: str, ask_side: str,
    name: str, side: str, accept: float = 0.68, same_side: float = 0.10,
) -> DataFrame:
    """The best-scoring known name per question, where the score reaches `accept`.

    A score of .58 before the side bonus needs a shared pair of neighbouring letters (padded at
    both ends; single letters also meet any name holding them), so candidates come from an
    equi-join on pairs of distinct names. Questions of one name and side share their answer, which is found
    once, as a minimum that tasks combine. Ties go to the smaller name, then side.
    """
    block = list(block)
    a = asked.select(*block, F.col(ask_id).alias("_id"), name_key(ask_name).alias("_short"), name_key(ask_side).alias("_as"))
    k = known.select(*block, F.col(name).alias("match"), F.col(side).alias("match_side"), name_key(name).alias("_full"), name_key(side).alias("_ks")).distinct()
    short = a.select(*block, "_short").distinct()
    full = k.select(*block, "_full").distinct()
    letters = F.transform(F.split(F.col("_full"), ""), lambda c: F.concat(F.lit("1:"), c))
    one = F.when(F.length("_short") == 1, F.array(F.concat(F.lit("1:"), F.col("_short")))).otherwise(F.array().cast("array<string>"))
    left = short.select(*block, "_short", F.explode(F.array_union(_grams(F.col("_short")), one)).alias("_g"))
    right = full.select(*block, "_full", F.explode(F.array_union(_grams(F.col("_full")), letters)).alias("_g"))
    near = left.join(right, [*block, "_g"]).select(*block, "_short", "_full").distinct()
    scored = near.withColumn("_sim", name_similarity(F.col("_short"), F.col("_full"))).where(
        F.col("_sim") >= accept - same_side
    )
    found = a.select(*block, "_short", "_as").distinct().join(scored, [*block, "_short"]).join(k, [*block, "_full"])
    together = F.contains("_ks", F.col("_as")) | F.contains("_as", F.col("_ks"))
    score = F.col("_sim") + F.when(together, same_side).otherwise(0.0)
    order = F.struct((-score).alias("_minus"), F.col("match"), F.col("match_side"))
    best = found.groupBy(*block, "_short", "_as").agg(F.min(order).alias("_b")).select(*[F.col(c).alias(f"_of_{c}") for c in (*block, "_short", "_as")], "_b")
    same = [F.col(c) == F.col(f"_of_{c}") for c in (*block, "_short")] + [F.col("_as").eqNullSafe(F.col("_of__as"))]
    answers = a.join(best, same).groupBy(*block, "_id").agg(F.min("_b").alias("_b"))
    return answers.where(-F.col("_b._minus") >= accept).select(
        *block, F.col("_id").alias(ask_id), "_b.match", "_b.match_side", F.least(-F.col("_b._minus"), F.lit(1.0)).alias("score")
    )


def best_replacement(
    owned: DataFrame, market: DataFrame, decision: str, deadline: str, side_cap: int = 3
) -> DataFrame:
    """For each owned entity the best-scoring affordable one of its stratum that is not owned.

    owned: (decision, deadline, entity, position, side, sale_price, bank, score);
    market: (deadline, entity, position, side, price, score, slate). A side already holding
    `side_cap` is closed unless it is the outgoing side. A squad can block at most its own size per
    (side, price), so of each such cell one more than the largest squad holds is all that can ever be chosen.
    """
    squad_size = owned.groupBy(decision).count().agg(F.max("count")).first()[0] or 0
    offers = top_k(
        market.where(F.col("slate") > 0), [deadline, "position", "side", "price"],
        [F.desc("score"), F.asc("entity")], squad_size + 1, "_r",
    ).select(deadline, "position", F.col("side").alias("in_side"), "price", F.col("entity").alias("in_entity"), F.col("score").alias("in_score"))
    squads = owned.groupBy(decision).agg(F.collect_list("entity").alias("_held"), F.collect_list("side").alias("_sides"))
    asked = owned.join(squads, decision)
    pairs = asked.join(offers, [deadline, "position"]).where(
        (F.col("price") <= F.col("sale_price") + F.col("bank")) & ~F.array_contains("_held", F.col("in_entity"))
    )
    held = F.size(F.filter("_sides", lambda s: s == F.col("in_side")))
    open_side = (F.col("in_side") == F.col("side")) | (held < side_cap)
    best = F.max_by(F.struct("in_entity", "price", "in_side", "in_score"), F.struct(F.col("in_score"), -F.col("in_entity")))
    return pairs.where(open_side).groupBy(decision, deadline, "entity", "score").agg(best.alias("_b")).select(
        decision, deadline, "entity", F.col("_b.in_entity").alias("replacement"), F.col("_b.price").alias("price"),
        (F.col("_b.in_score") - F.col("score")).alias("gain"),
    )


def distinct_suggestions(best: DataFrame, decision: str, at_most: int = 3, least_gain: float = 1.5) -> DataFrame:
    """The largest gains of a decision, each target offered once (for its best exit)."""
    once = Window.partitionBy(decision, "replacement").orderBy(F.desc("gain"), F.asc("entity"))
    kept = best.where(F.col("gain") >= least_gain).withColumn("_r", F.row_number().over(once)).where(F.col("_r") == 1).drop("_r")
    return top_k(kept, [decision], [F.desc("gain"), F.asc("entity")], at_most, "place")


def fit_odds(matches: DataFrame, home: str, draw: str, away: str, over: str | None = None, **grid) -> DataFrame:
    """Poisson rate pair of each distinct set of probabilities, joined back to the matches."""
    keys = [home, draw, away, *([over] if over else [])]
    # a fit is heavy and its rows are narrow: keep them spread over the tasks
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = matches.select(*keys).distinct().repartition(parts, *keys).withColumn("_fit", fit_goal_rates(home, draw, away, over, **grid))
    rates = fitted.select(*keys, "_fit.home_rate", "_fit.away_rate")
    on = None
    renamed = rates.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "home_rate", "away_rate")
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = test if on is None else on & test
    return matches.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def blend_match_rates(matches: DataFrame, market: DataFrame, published: DataFrame, key: Sequence[str], **grid) -> DataFrame:
    """Internal home and away rates mixed with the outside rates of each match.

    matches: key, home_for, away_for, home_win; market: key, home_p, draw_p, away_p, quality;
    published: key, home_p, draw_p, away_p. Gaps are null where their source is absent.
    """
    def prefixed(df, tag):
        return df.select(*key, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in key])

    joined = matches.join(prefixed(market, "m"), list(key), "left").join(prefixed(published, "p"), list(key), "left")
    for outcome in ("home", "draw", "away"):
        joined = joined.withColumn(f"e_{outcome}", blend_sources(f"m_{outcome}_p", f"p_{outcome}_p"))
    outside = fit_odds(joined.where(F.col("e_home").isNotNull()).select(*key, "e_home", "e_draw", "e_away"), "e_home", "e_draw", "e_away", **grid)
    both = joined.join(outside.select(*key, "home_rate", "away_rate"), list(key), "left")
    share = market_weight("m_quality")
    home = F.when(F.col("home_rate").isNull(), F.col("home_for")).otherwise((1 - share) * F.col("home_for") + share * F.col("home_rate"))
    away = F.when(F.col("away_rate").isNull(), F.col("away_for")).otherwise((1 - share) * F.col("away_for") + share * F.col("away_rate"))
    return both.select(
        *key, share.alias("weight"), home.alias("home"), away.alias("away"),
        F.exp(-away).alias("home_clean"), F.exp(-home).alias("away_clean"),
        (F.col("home_win") - F.col("m_home_p")).alias("market_gap"), (F.col("home_win") - F.col("e_home")).alias("outside_gap"),
    )


def forward_rates(schedule: DataFrame, rates: DataFrame, now: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Weighted mean rates of a side over its next fixtures; the current one from `now`.

    schedule: (epoch, period, side, opponent, is_home); rates: (epoch, period, side, opponent,
    is_home, <names>) as known in the base period; now: (epoch, period, side, <names>).
    """
    names = list(defaults)
    slots = next_periods(schedule, "epoch", "period")
    games = schedule.select("epoch", F.col("period").alias("target"), "side", "opponent", "is_home")
    asked = schedule.select("epoch", "period", "side").distinct().join(slots, ["epoch", "period"])
    timed = asked.join(games, ["epoch", "target", "side"])
    current = now.select("epoch", "period", "side", *[F.col(n).alias(f"_now_{n}") for n in names])
    valued = timed.join(rates, ["epoch", "period", "side", "opponent", "is_home"], "left").join(current, ["epoch", "period", "side"], "left")
    w = F.col("weight")
    sums = []
    for n in names:
        value = F.when(F.col("slot") == 0, F.coalesce(F.col(f"_now_{n}"), F.col(n))).otherwise(F.col(n))
        value = F.coalesce(value, F.lit(defaults[n]))
        sums.append((F.sum(w * value) / F.sum(w)).alias(n))
    return valued.groupBy("epoch", "period", "side").agg(*sums)
