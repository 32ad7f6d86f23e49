"""Window features over the panel (inventory group E)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from ..operators import windows as w
from ..operators.scale import percentile_rank
from .bindings import FORECASTS, PANEL, USER_DAYS, forecasts, panel, table, user_days
from .registry import query, r6

KEY = ["entity", "period"]


def line():
    return w.timeline("entity", "period")


def seen():
    """Points of rows with a slate; null otherwise."""
    return F.when(F.col("slate") > 0, F.col("points"))


SEEN_SQL = "CASE WHEN slate>0 THEN points END"


def over(rows: int | None, part: str = "entity", order: str = "period") -> str:
    start = "UNBOUNDED" if rows is None else rows
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {start} PRECEDING AND 1 PRECEDING)"


@query("E1_prior_sum", PANEL + f"SELECT entity, period, CAST(coalesce(sum(points) {over(None)},0) AS BIGINT) AS total FROM panel")
def e1(spark, sf):
    return panel(spark, sf).select(*KEY, w.prior_sum("points", line()).alias("total"))


@query("E2_prior_expanding_mean", PANEL + f"SELECT entity, period, round(avg({SEEN_SQL}) {over(None)},6) AS long_form FROM panel")
def e2(spark, sf):
    return panel(spark, sf).select(*KEY, r6(w.prior_mean(seen(), line())).alias("long_form"))


@query("E3_prior_rolling_mean", PANEL + f"""SELECT entity, period, round(CASE WHEN count({SEEN_SQL}) {over(4)}>=2 THEN avg({SEEN_SQL}) {over(4)} END,6) AS recent4,
 round(avg({SEEN_SQL}) {over(2)},6) AS recent2, round(avg({SEEN_SQL}) {over(2)}-avg({SEEN_SQL}) {over(6)},6) AS change_2v6 FROM panel""")
def e3(spark, sf):
    two, six = w.prior_mean(seen(), line(), 2), w.prior_mean(seen(), line(), 6)
    return panel(spark, sf).select(
        *KEY, r6(w.prior_mean(seen(), line(), 4, 2)).alias("recent4"), r6(two).alias("recent2"), r6(two - six).alias("change_2v6")
    )


@query("E4_prior_rolling_sum", PANEL + f"SELECT entity, period, CAST(coalesce(sum(slate) {over(10)},0) AS BIGINT) AS games10, CAST(coalesce(sum(goals) {over(18)},0) AS BIGINT) AS goals18 FROM panel")
def e4(spark, sf):
    return panel(spark, sf).select(*KEY, w.prior_sum("slate", line(), 10).alias("games10"), w.prior_sum("goals", line(), 18).alias("goals18"))


@query("E5_prior_rolling_std", PANEL + f"SELECT entity, period, round(CASE WHEN count({SEEN_SQL}) {over(8)}>=2 THEN stddev_samp({SEEN_SQL}) {over(8)} END,6) AS volatility FROM panel")
def e5(spark, sf):
    return panel(spark, sf).select(*KEY, r6(w.prior_std(seen(), line(), 8)).alias("volatility"))


def ewm_sql(name: str, source: str, part: str, order: str, x: str, alpha: float) -> str:
    """CTEs that walk each series row by row; `{name}`.y is the mean before the row."""
    return f""", {name}_s AS (SELECT {part}, {order}, ({x})::DOUBLE AS x, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM {source}),
{name} AS (SELECT {part}, {order}, x, rn, NULL::DOUBLE AS y, 1e0 AS w FROM {name}_s WHERE rn=1 UNION ALL
 SELECT {', '.join('n.' + c.strip() for c in part.split(','))}, {', '.join('n.' + c.strip() for c in order.split(','))}, n.x, n.rn,
  CASE WHEN p.x IS NULL THEN p.y WHEN p.y IS NULL THEN p.x ELSE (p.w*(1-{alpha}e0)*p.y+{alpha}e0*p.x)/(p.w*(1-{alpha}e0)+{alpha}e0) END,
  CASE WHEN p.x IS NULL THEN p.w*(1-{alpha}e0) ELSE 1e0 END
 FROM {name} p JOIN {name}_s n ON {' AND '.join(f'n.{c.strip()}=p.{c.strip()}' for c in part.split(','))} AND n.rn=p.rn+1)"""


@query("E6_prior_ewm", "WITH RECURSIVE " + PANEL[5:] + ewm_sql("e", "panel", "entity", "period", SEEN_SQL, 0.22) + " SELECT entity, period, round(y,6) AS form FROM e")
def e6(spark, sf):
    return w.attach_prior_ewm(panel(spark, sf), {"form": (seen(), 0.22)}, line()).select(*KEY, r6("form").alias("form"))


@query("E7_lag_lead_gap", USER_DAYS + """SELECT entity, period, round(coalesce(CASE WHEN lag(first_ts) OVER u IS NOT NULL THEN least(14e0,greatest(2e0,date_diff('microsecond', lag(first_ts) OVER u, first_ts)/86400000000e0)) END,7e0),6) AS rest_days,
 lead(points) OVER u - points AS next_change FROM ud WINDOW u AS (PARTITION BY entity ORDER BY period)""")
def e7(spark, sf):
    return user_days(spark, sf).select(
        *KEY, r6(w.days_since("first_ts", line())).alias("rest_days"), (F.lead("points").over(line()) - F.col("points")).alias("next_change")
    )


def pct_sql(x: str, part: str) -> str:
    return (f"((rank() OVER (PARTITION BY {part}, ({x}) IS NULL ORDER BY {x})-1+(count(*) OVER (PARTITION BY {part}, {x})+1)/2e0)"
            f"/count({x}) OVER (PARTITION BY {part}))")


@query("E8_percentile_rank", PANEL + f"""SELECT entity, period, round(CASE WHEN points IS NULL OR slate=0 OR count({SEEN_SQL}) OVER (PARTITION BY period, position)<2 THEN 0.5e0 ELSE {pct_sql('(' + SEEN_SQL + ')', 'period, position')} END,6) AS standing,
 round({pct_sql('price', 'period, position')},6) AS price_standing FROM panel""")
def e8(spark, sf):
    base = panel(spark, sf).withColumn("seen", seen())
    filled = percentile_rank(base, ["period", "position"], "seen", "standing")
    both = percentile_rank(filled, ["period", "position"], "price", "price_standing", fill=None)
    return both.select(*KEY, r6("standing").alias("standing"), r6("price_standing").alias("price_standing"))


@query("E9_ranked_frontier", FORECASTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY f_base DESC, entity) AS a,
 row_number() OVER (PARTITION BY period, position ORDER BY f_base/greatest(price/10e0,3.5e0) DESC, entity) AS b FROM fp)
SELECT entity, period FROM r WHERE a<=3 OR b<=2 OR (prob>=0.5 AND a<=6)""")
def e9(spark, sf):
    fp = forecasts(spark, sf).withColumn("value", F.col("f_base") / F.greatest(F.col("price") / 10.0, F.lit(3.5)))
    return w.frontier(fp, ["period", "position"], "entity", "f_base", "value", "prob", 3, 2, 6, 0.5).select(*KEY)


@query("E10_group_median_attach", FORECASTS + """, g AS (SELECT period, position, quantile_cont(f_base,0.5) AS med, count(*) AS size, CAST(sum(points) AS BIGINT) AS total FROM fp GROUP BY ALL)
SELECT entity, period, round(med,6) AS med, size, total FROM fp JOIN g USING (period, position)""")
def e10(spark, sf):
    fp = forecasts(spark, sf).select("entity", "period", "position", "f_base", "points")
    keys = ["period", "position"]
    both = w.attach_median(w.attach_group(fp, keys, size=F.count(F.lit(1)), total=F.sum("points")), keys, "f_base", "med")
    return both.select(*KEY, r6("med").alias("med"), "size", "total")


@query("E11_forward_fill", PANEL + f"""SELECT entity, period, last_value(CASE WHEN slate>2 THEN price END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held_price,
 coalesce(last_value(CASE WHEN slate>2 THEN price END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(CASE WHEN slate>2 THEN price END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled_price FROM panel""")
def e11(spark, sf):
    known = F.when(F.col("slate") > 2, F.col("price"))
    held = w.forward_fill(known, line())
    return panel(spark, sf).select(*KEY, held.alias("held_price"), F.coalesce(held, w.back_fill(known, line())).alias("filled_price"))


SIDES = """, side_panel AS (SELECT epoch, period, side, CAST(count(*) AS INTEGER) AS games, CAST(sum(goals) AS BIGINT) AS scored, CAST(sum(assists) AS BIGINT) AS x_scored,
 CAST(sum(conceded) AS BIGINT) AS lost, CAST(sum(bonus) AS BIGINT) AS x_lost, CAST(sum(points) AS BIGINT) AS results, CAST(count(*) FILTER (clean>=4) AS BIGINT) AS cleans FROM panel GROUP BY ALL)
"""


def side_panel(spark, sf):
    return panel(spark, sf).groupBy("epoch", "period", "side").agg(
        F.count(F.lit(1)).cast("int").alias("games"), F.sum("goals").alias("scored"), F.sum("assists").alias("x_scored"),
        F.sum("conceded").alias("lost"), F.sum("bonus").alias("x_lost"), F.sum("points").alias("results"),
        F.count(F.when(F.col("clean") >= 4, 1)).alias("cleans"),
    )


@query("E12_table_position", PANEL + SIDES + f""", b AS (SELECT epoch, period, side, coalesce(sum(results) {over(None, 'epoch, side')},0) AS p, coalesce(sum(scored) {over(None, 'epoch, side')},0) AS s, coalesce(sum(scored) {over(None, 'epoch, side')},0)-coalesce(sum(lost) {over(None, 'epoch, side')},0) AS d FROM side_panel)
SELECT epoch, period, side, CAST(p AS BIGINT) AS points_before, CAST(row_number() OVER (PARTITION BY epoch, period ORDER BY p DESC, d DESC, s DESC, side) AS INTEGER) AS place FROM b""")
def e12(spark, sf):
    out = w.table_position(side_panel(spark, sf), "epoch", "period", "side", "results", "scored", "lost")
    return out.select("epoch", "period", "side", "points_before", "place")


def label_sql(h: int) -> str:
    terms = "+".join(["points"] + [f"{0.86 ** k!r}::DOUBLE*coalesce(lead(points,{k}) OVER u,0)" for k in range(1, h)])
    return f"round({terms},6) AS target{h}, CAST(max(period) OVER (PARTITION BY epoch, entity ORDER BY period ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) AS INTEGER) AS end{h}"


@query("E13_forward_labels", PANEL + f"SELECT entity, period, {', '.join(label_sql(h) for h in (3, 6, 10))} FROM panel WINDOW u AS (PARTITION BY epoch, entity ORDER BY period)")
def e13(spark, sf):
    line = w.timeline(["epoch", "entity"], "period")
    outs = []
    for h in (3, 6, 10):
        total, end = w.forward_label("points", "period", line, h)
        outs += [r6(total).alias(f"target{h}"), end.alias(f"end{h}")]
    return panel(spark, sf).select(*KEY, *outs)


@query("E14_event_numbers", PANEL + """, c AS (SELECT DISTINCT epoch, period FROM panel), n AS (SELECT epoch, period, row_number() OVER (PARTITION BY epoch ORDER BY period) AS n, count(*) OVER (PARTITION BY epoch) AS k FROM c)
SELECT entity, period, CAST(n AS INTEGER) AS event_number, CAST(k-n+1 AS BIGINT) AS remaining FROM panel JOIN n USING (epoch, period)""")
def e14(spark, sf):
    return w.event_numbers(panel(spark, sf), "epoch", "period").select(*KEY, "event_number", "remaining")


def drought_rows(spark, sf):
    fp = forecasts(spark, sf)
    missing = F.col("price") % 3 == 0
    return fp.select(
        "entity", "period", "points", F.col("f_base").alias("forecast"), F.when(F.col("slate") == 1, 0).otherwise(F.col("minutes")).alias("minutes"),
        (F.col("lines") / 8.0).alias("play"), (F.col("f_base") * 5 + 35).alias("expected_minutes"),
        (F.col("conceded") >= 6).alias("severe"), F.when(~missing, F.col("f_price") - F.col("f_base")).alias("plan_delta"),
        F.when(~missing, F.col("f_exp") - F.col("f_base")).alias("decision_delta"), (F.col("goals") % 2 == 0).alias("transfer_made"),
        (F.col("bonus") / 8.0).alias("fall_probability"), (F.col("assists") / 20.0).alias("pressure_rank"),
        F.when(~missing, F.col("f_exp")).alias("hindsight"), "slate", "lines",
    )


@query("E15_spells", FORECASTS + """, q AS (SELECT *, period-row_number() OVER (PARTITION BY entity ORDER BY period) AS spell FROM fp WHERE lines>=3 AND slate>0 AND points<5),
o AS (SELECT *, row_number() OVER (PARTITION BY entity, spell ORDER BY period)-1 AS k, count(*) OVER (PARTITION BY entity, spell) AS c, CASE WHEN slate=1 THEN 0 ELSE minutes END AS m, lines/8e0 AS play, f_base*5+35 AS em,
 CASE WHEN price%3<>0 THEN f_price-f_base END AS pd, CASE WHEN price%3<>0 THEN f_exp-f_base END AS dd, CASE WHEN price%3<>0 THEN f_exp END AS hs FROM q),
x AS (SELECT *, coalesce(pd>=1.5,false) AS clears, (play<0.72 OR em<52 OR conceded>=6) AS fading, (bonus/8e0>=0.55 OR assists/20e0<=0.15) AS leaving FROM o WHERE c>=3),
s AS (SELECT entity, min(period) AS "start", max(period) AS "end", CAST(count(*) AS INTEGER) AS weeks, CAST(sum(points) AS DOUBLE) AS actual, sum(f_base) AS projected,
 CAST(count(*) FILTER (m<=0) AS INTEGER) AS no_shows, avg(play) AS average_play, count(*) FILTER (clears) AS cl, count(*) FILTER (clears AND goals%2<>0) AS fr, count(*) FILTER (fading) AS fa,
 CAST(count(*) FILTER (fading OR clears OR leaving OR k>=2) AS INTEGER) AS warnings, CAST(count(*) FILTER (coalesce(dd>=1.5 AND pd<1.5,false)) AS INTEGER) AS mismatches,
 bool_and(k>=2 OR (play>=0.78 AND em>=58)) AS steady, coalesce(max(hs),0) AS bh, min(CASE WHEN fading OR clears OR leaving OR k>=2 THEN period END) AS first_warning FROM x GROUP BY entity, spell)
SELECT entity, "start", "end", weeks, actual, round(projected,4) AS projected, no_shows, round(average_play,6) AS average_play, warnings, mismatches, first_warning, round(bh,6) AS best_hindsight, round(projected-actual,4) AS shortfall,
 CASE WHEN fr>0 THEN 'local transfer opportunity conflict' WHEN cl>0 THEN 'transfer prioritised elsewhere' WHEN no_shows>=2 AND fa>0 THEN 'foreseeable availability decay' WHEN steady AND projected-actual>=6 THEN 'rough patch / outcome variance' WHEN warnings>0 THEN 'mixed warning' ELSE 'unforeseeable or weak evidence' END AS classification FROM s""")
def e15(spark, sf):
    rows = drought_rows(spark, sf)
    runs = w.spells(rows, "entity", "period", (F.col("lines") >= 3) & (F.col("slate") > 0) & (F.col("points") < 5), 3)
    out = w.droughts(runs, "entity", "period", 1.5)
    return out.select(
        "entity", "start", "end", "weeks", "actual", F.round("projected", 4).alias("projected"), "no_shows",
        r6("average_play").alias("average_play"), "warnings", "mismatches", F.get("timeline", F.lit(0))["period"].alias("first_warning"),
        r6("best_hindsight").alias("best_hindsight"), F.round("shortfall", 4).alias("shortfall"), "classification",
    )


@query("E16_first_negative_period", PANEL + """, c AS (SELECT entity, period, sum(goals-assists) OVER (PARTITION BY entity ORDER BY period) AS t FROM panel)
SELECT entity, min(CASE WHEN t<0 THEN period END) AS first_negative FROM c GROUP BY entity""")
def e16(spark, sf):
    running = F.sum(F.col("goals") - F.col("assists")).over(line().rowsBetween(Window.unboundedPreceding, 0))
    return panel(spark, sf).select("entity", "period", running.alias("t")).groupBy("entity").agg(
        F.min(F.when(F.col("t") < 0, F.col("period"))).alias("first_negative")
    )


@query("E17_availability_flags", PANEL + """, x AS (SELECT *, lines%5<>0 AS tr, goals-1 AS xp, CASE WHEN slate<2 THEN 0 ELSE minutes END AS m, transfers/300e0 AS pr FROM panel),
y AS (SELECT *, slate>0 AND tr AND xp<=0 AS z, coalesce(lag(tr) OVER u,false) AND coalesce(lag(xp) OVER u<=0,false) AND coalesce(lag(m) OVER u,0)<=0 AS was, slate>0 AND pr<=-0.9 AND coalesce(lag(m) OVER u<60,false) AS mk FROM x WINDOW u AS (PARTITION BY entity ORDER BY period))
SELECT entity, period, z AS zero_signal, mk AS market_warning, (z AND pr<=-0.75) OR (z AND was) OR mk AS severe_warning FROM y""")
def e17(spark, sf):
    p = panel(spark, sf).select(
        *KEY, "slate", (F.col("lines") % 5 != 0).alias("tr"), (F.col("goals") - 1).alias("xp"),
        F.when(F.col("slate") < 2, 0).otherwise(F.col("minutes")).alias("m"), (F.col("transfers") / 300.0).alias("pr"),
    )
    flags = w.availability_flags(F.col("tr"), F.col("xp"), F.col("m"), F.col("slate"), F.col("pr"), line())
    return p.select(*KEY, *[c.alias(n) for n, c in flags.items()])


@query("E18_linspace_rank", FORECASTS + """, r AS (SELECT entity, period, row_number() OVER (PARTITION BY period, position ORDER BY f_base, entity) AS n, count(*) OVER (PARTITION BY period, position) AS k FROM fp)
SELECT entity, period, round(CASE WHEN k=1 THEN 1e0 ELSE (n-1)/(k-1)::DOUBLE END,6) AS standing FROM r""")
def e18(spark, sf):
    return w.linspace_rank(forecasts(spark, sf), ["period", "position"], "f_base", "entity", "standing").select(
        *KEY, r6("standing").alias("standing")
    )


# Prior success rate by position.
START_PRIOR = {1: 0.68, 2: 0.58, 3: 0.56, 4: 0.54}


@query("E19_shrunk_rate", PANEL + f"""SELECT entity, period, round(least(0.98e0,greatest(0.03e0,(coalesce(sum(goals) {over(10)},0)+4*CASE position WHEN 1 THEN 0.68e0 WHEN 2 THEN 0.58e0 WHEN 3 THEN 0.56e0 ELSE 0.54e0 END)/(coalesce(sum(lines) {over(10)},0)+4))),6) AS rate FROM panel""")
def e19(spark, sf):
    rate = w.shrunk_prior_rate("goals", "lines", lookup(F.col("position"), START_PRIOR), 4.0, line(), 10, 0.03, 0.98)
    return panel(spark, sf).select(*KEY, r6(rate).alias("rate"))


@query("E20_matchup_history", "WITH RECURSIVE " + FORECASTS[5:] + ", h AS (SELECT *, slate=1 AND minutes>0 AS played FROM fp)"
       + ewm_sql("e", "h", "entity, opponent", "period", "CASE WHEN played THEN points END", 0.45)
       + f""", n AS (SELECT h.*, y, coalesce(sum(CASE WHEN played THEN 1 ELSE 0 END) {over(None)},0) AS mt, coalesce(sum(CASE WHEN played THEN 1 ELSE 0 END) {over(None, 'entity, opponent')},0) AS np, coalesce(sum(CASE WHEN played THEN points ELSE 0 END) {over(None, 'entity, opponent')},0) AS pp,
 coalesce(sum(CASE WHEN played THEN 1 ELSE 0 END) {over(None, 'entity, opponent, is_home')},0) AS nv, coalesce(sum(CASE WHEN played THEN points ELSE 0 END) {over(None, 'entity, opponent, is_home')},0) AS pv FROM h JOIN e USING (entity, opponent, period))
SELECT entity, period, CAST(mt AS BIGINT) AS matches, CAST(np AS BIGINT) AS pair_matches, round((pp+8*f_exp)/(np+8),6) AS pair_points, round(least(1.5e0,greatest(-1.5e0,(pp+8*f_exp)/(np+8)-f_exp)),6) AS pair_uplift,
 round((least(np,4)*coalesce(y,f_exp)+6*f_exp)/(least(np,4)+6),6) AS pair_recent, round(1-exp(-np/3e0),6) AS pair_evidence, round((pv+10*f_exp)/(nv+10),6) AS venue_points FROM n""")
def e20(spark, sf):
    played = (F.col("slate") == 1) & (F.col("minutes") > 0)
    out = w.matchup_history(forecasts(spark, sf), "entity", "opponent", "is_home", ["period"], played, F.col("points"), F.col("f_exp"))
    return out.select(*KEY, "matches", "pair_matches", *[
        r6(c).alias(c) for c in ("pair_points", "pair_uplift", "pair_recent", "pair_evidence", "venue_points")
    ])


@query("E21_group_pressure", PANEL + """, g AS (SELECT period, side, position, count(*) FILTER (slate>=2) AS v FROM panel GROUP BY ALL)
SELECT entity, period, round(least(1.5e0,greatest(0,v-CASE position WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 WHEN 3 THEN 2e0 ELSE 1e0 END)/CASE position WHEN 1 THEN 1e0 WHEN 2 THEN 2e0 WHEN 3 THEN 2e0 ELSE 1e0 END),6) AS pressure FROM panel JOIN g USING (period, side, position)""")
def e21(spark, sf):
    slots = lookup(F.col("position"), {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0})
    out = w.group_pressure(panel(spark, sf), ["period", "side", "position"], F.col("slate") >= 2, slots, "pressure")
    return out.select(*KEY, r6("pressure").alias("pressure"))


@query("E22_lineup_change", PANEL + f""", t AS (SELECT *, row_number() OVER (PARTITION BY epoch, side, period ORDER BY minutes DESC, points DESC, entity) AS n FROM panel),
l AS (SELECT epoch, side, period, list_sort(list(entity)) AS m FROM t WHERE n<=3 GROUP BY ALL),
c AS (SELECT epoch, side, period, m, lag(m) OVER (PARTITION BY epoch, side ORDER BY period) AS pm FROM l),
d AS (SELECT *, CASE WHEN pm IS NOT NULL THEN 1-len(list_intersect(m,pm))/greatest(1,least(len(m),len(pm),11))::DOUBLE END AS ch FROM c)
SELECT epoch, side, period, round(least(0.75e0,greatest(0,coalesce(avg(ch) {over(6, 'epoch, side')},0.22e0))),6) AS rotation FROM d""")
def e22(spark, sf):
    starters = w.top_k(panel(spark, sf), ["epoch", "side", "period"], [F.desc("minutes"), F.desc("points"), F.asc("entity")], 3)
    lineups = starters.groupBy("epoch", "side", "period").agg(F.collect_set("entity").alias("members"))
    out = w.lineup_change(lineups, ["epoch", "side"], "period", "members")
    return out.select("epoch", "side", "period", r6("rotation").alias("rotation"))


OBS = "CASE WHEN {e}>0 THEN 0.72e0*({e}/g)+0.28e0*({r}/g) ELSE {r}/g END"
RATINGS = SIDES + f""", lg0 AS (SELECT epoch, period, sum(scored)/greatest(sum(games),1)::DOUBLE AS o FROM side_panel GROUP BY ALL),
lg AS (SELECT epoch, period, least(2e0,greatest(0.9e0,coalesce(avg(o) {over(None, 'epoch')},1.4e0))) AS league FROM lg0),
sb AS (SELECT *, greatest(games,1)::DOUBLE AS g FROM side_panel),
so AS (SELECT s.epoch, s.period, side, games, league, {OBS.format(e='x_scored', r='scored')} AS oa, {OBS.format(e='x_lost', r='lost')} AS od, results/g AS ofm, cleans/g AS oc,
 CASE WHEN s.epoch>0 AND NOT EXISTS (SELECT 1 FROM side_panel q WHERE q.epoch=s.epoch-1 AND q.side=s.side) THEN 1e0 ELSE 0e0 END AS fresh,
 s.period-min(s.period) OVER (PARTITION BY s.epoch)+1 AS gw, coalesce(sum(games) {over(None, 'side', 's.epoch, s.period')},0) AS known FROM sb s JOIN lg ON s.epoch=lg.epoch AND s.period=lg.period)
""" + "".join(ewm_sql(n, "so", "side", "epoch, period", x, a) for n, x, a in (
    ("ea", "oa", 0.22), ("ed", "od", 0.22), ("ef", "ofm", 0.22), ("ec", "oc", 0.22), ("fa", "oa", 0.48), ("fd", "od", 0.48))) + """
, r0 AS (SELECT so.*, least(0.94e0,known/(known+8e0)) AS cf, coalesce(ea.y,league) AS ya, coalesce(ed.y,league) AS yd, coalesce(ef.y,1.35e0) AS yf, coalesce(ec.y,0.28e0) AS yc, coalesce(fa.y,league) AS za, coalesce(fd.y,league) AS zd,
 fresh*exp(-greatest(gw-1,0)/8e0) AS nw FROM so JOIN ea USING (side, epoch, period) JOIN ed USING (side, epoch, period) JOIN ef USING (side, epoch, period) JOIN ec USING (side, epoch, period) JOIN fa USING (side, epoch, period) JOIN fd USING (side, epoch, period)),
r1 AS (SELECT *, least(2.7e0,greatest(0.45e0,cf*ya+(1-cf)*league)) AS ra, least(2.7e0,greatest(0.45e0,cf*yd+(1-cf)*league)) AS rd, least(3e0,greatest(0,cf*yf+(1-cf)*1.35e0)) AS form, least(0.75e0,greatest(0,cf*yc+(1-cf)*0.28e0)) AS clean_rate FROM r0),
r2 AS (SELECT *, least(0.85e0,greatest(0,1-(1-least(0.75e0,(abs(za-ra)+abs(zd-rd))/(2*greatest(league,0.8e0))))*(1-0.62e0*nw))) AS shift FROM r1),
r3 AS (SELECT *, least(0.75e0,greatest(0.25e0,0.25e0+shift)) AS wt, least(0.42e0,0.42e0*nw) AS sh FROM r2),
ratings AS (SELECT epoch, period, side, league, form, clean_rate AS clean, shift, least(0.94e0,cf*(1-0.52e0*shift)) AS confidence,
 least(2.7e0,greatest(0.45e0,(1-sh)*least(2.7e0,greatest(0.45e0,(1-wt)*ra+wt*za))+sh*league)) AS attack, least(2.7e0,greatest(0.45e0,(1-sh)*least(2.7e0,greatest(0.45e0,(1-wt)*rd+wt*zd))+sh*league)) AS defence FROM r3)
"""


@query("E23_side_ratings", "WITH RECURSIVE " + PANEL[5:] + RATINGS + "SELECT epoch, period, side, round(league,6) AS league, round(attack,6) AS attack, round(defence,6) AS defence, round(form,6) AS form, round(clean,6) AS clean, round(shift,6) AS shift, round(confidence,6) AS confidence FROM ratings")
def e23(spark, sf):
    out = w.side_ratings(side_panel(spark, sf))
    return out.select("epoch", "period", "side", *[
        r6(c).alias(c) for c in ("league", "attack", "defence", "form", "clean", "shift", "confidence")
    ])


@query("E24_matchup_rates", "WITH RECURSIVE " + PANEL[5:] + RATINGS + """, m AS (SELECT entity, p.period, is_home, least(2e0,greatest(0.9e0,coalesce(a.league,1.4e0))) AS lg, coalesce(a.attack,least(2e0,greatest(0.9e0,coalesce(a.league,1.4e0)))) AS oa, coalesce(a.defence,least(2e0,greatest(0.9e0,coalesce(a.league,1.4e0)))) AS od,
 coalesce(b.attack,least(2e0,greatest(0.9e0,coalesce(a.league,1.4e0)))) AS ta, coalesce(b.defence,least(2e0,greatest(0.9e0,coalesce(a.league,1.4e0)))) AS td FROM panel p LEFT JOIN ratings a ON a.epoch=p.epoch AND a.period=p.period AND a.side=p.side LEFT JOIN ratings b ON b.epoch=p.epoch AND b.period=p.period AND b.side=p.opponent)
, k AS (SELECT *, least(3.4e0,greatest(0.3e0,lg*pow(oa/lg,0.7e0)*pow(td/lg,0.7e0)*CASE WHEN is_home THEN 1.12e0 ELSE 0.88e0 END)) AS ef, least(3.4e0,greatest(0.3e0,lg*pow(od/lg,0.7e0)*pow(ta/lg,0.7e0)*CASE WHEN is_home THEN 0.88e0 ELSE 1.12e0 END)) AS eg FROM m)
SELECT entity, period, round(ef,6) AS expected_for, round(eg,6) AS expected_against, round(least(0.74e0,greatest(0.03e0,exp(-eg))),6) AS clean_chance FROM k""")
def e24(spark, sf):
    from ..operators.joins import two_roles

    ratings = w.side_ratings(side_panel(spark, sf)).select("epoch", "period", "side", "league", "attack", "defence")
    both = two_roles(panel(spark, sf), ratings, ["epoch", "period"], "side", "opponent", "side")
    rates = w.matchup_rates("own_league", "own_attack", "own_defence", "opp_attack", "opp_defence", "is_home")
    return both.select(*KEY, *[r6(c).alias(n) for n, c in rates.items()])


@query("E25_allowed_by_opponent", PANEL + f""", a AS (SELECT epoch, opponent, position, period, avg(points) AS pa, avg(goals) AS ga FROM panel GROUP BY ALL)
SELECT epoch, opponent, position, period, round(avg(pa) {over(None, 'epoch, opponent, position')},6) AS allowed, round(CASE WHEN count(ga) {over(10, 'epoch, opponent, position')}>=2 THEN avg(ga) {over(10, 'epoch, opponent, position')} END,6) AS goals_allowed FROM a""")
def e25(spark, sf):
    keys = ["epoch", "opponent", "position"]
    allowed = panel(spark, sf).groupBy(*keys, "period").agg(F.avg("points").alias("pa"), F.avg("goals").alias("ga"))
    line = w.timeline(keys, "period")
    return allowed.select(
        *keys, "period", r6(w.prior_mean("pa", line)).alias("allowed"), r6(w.prior_mean("ga", line, 10, 2)).alias("goals_allowed")
    )


MIXES = {
    "protect": {"f_exp": 0.40, "f_base": 0.30, "minutes": 0.20, "saves": 0.10},
    "chase": {"f_price": 0.38, "f_base": 0.30, "selected": 0.22, "goals": 0.10},
}


CAPTAIN = {"f_base": 0.56}
CAPTAIN_PLAIN = {"fixture_now": 0.18, "security": 0.20, "crowd": 0.06}


def mix_sql(mix: dict) -> str:
    return "+".join(f"{v}e0*{pct_sql(c, 'period')}" for c, v in mix.items())


@query("E26_utility_mix", FORECASTS + f"""SELECT entity, period, round({mix_sql(MIXES['protect'])},6) AS protect, round({mix_sql(MIXES['chase'])},6) AS chase, round({mix_sql(CAPTAIN)}+0.18e0*CAST(is_home AS INTEGER)+0.2e0*(minutes/90e0)+0.06e0*(selected/10000e0),6) AS captain, rank() OVER (PARTITION BY period, position ORDER BY f_base DESC) AS position_rank FROM fp""")
def e26(spark, sf):
    fp = forecasts(spark, sf).withColumn("fixture_now", F.col("is_home").cast("double")).withColumn("security", F.col("minutes") / 90.0).withColumn("crowd", F.col("selected") / 10000.0)
    mixed = w.utility_mix(fp, ["period"], "entity", MIXES | {"captain": CAPTAIN}, {"captain": CAPTAIN_PLAIN})
    from ..operators.scale import ordered_prefix
    order = ordered_prefix(fp.withColumn("_v", -F.col("f_base")), ["period", "position"], "_v")
    ranked = mixed.withColumn("_v", -F.col("f_base")).join(
        order.select("period", "position", "_v", (F.col("n_before") + 1).alias("position_rank")), ["period", "position", "_v"]
    )
    return ranked.select(*KEY, r6("protect").alias("protect"), r6("chase").alias("chase"), r6("captain").alias("captain"), "position_rank")


@query("E27_congestion", """, f AS (""".replace(", f AS (", "WITH f AS (") + """SELECT CAST(o_custkey%40 AS INTEGER) AS h, CAST((o_custkey//40)%40 AS INTEGER) AS a, o_orderdate AS k FROM orders),
s AS (SELECT h AS side, k FROM f UNION ALL SELECT a, k FROM f), g AS (SELECT side, date_diff('microsecond', lag(k) OVER (PARTITION BY side ORDER BY k), k)/86400000000e0 AS gap FROM s)
SELECT side, round(coalesce(min(gap),7e0),6) AS minimum_gap FROM g GROUP BY side""")
def e27(spark, sf):
    fixtures = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).cast("int").alias("home"), F.expr("cast((o_custkey div 40) % 40 as int)").alias("away"), "o_orderdate"
    )
    out = w.congestion(fixtures, "home", "away", "o_orderdate")
    return out.select("side", r6("minimum_gap").alias("minimum_gap"))
