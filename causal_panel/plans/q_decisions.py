"""Decision-log analytics over squads drawn from the panel (inventory group D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import decisions as d
from ..operators import windows as w
from .bindings import FORECASTS, PANEL, forecasts, panel
from .q_scalars import CLEAN_SQL, GOAL_SQL
from .registry import query, r6

QUOTA_SQL = "CASE position WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 5 ELSE 3 END"


def squads(spark, sf):
    """Per period the quota of each position by long form; minutes are nil on thin months."""
    fp = forecasts(spark, sf)
    top = w.top_k(fp, ["period", "position"], [F.desc("f_exp"), F.asc("entity")], 5, "_r")
    quota = F.when(F.col("position") == 1, 2).when(F.col("position") == 4, 3).otherwise(5)
    played = F.when(F.col("slate") <= 1, 0).otherwise(F.col("minutes"))
    return top.where(F.col("_r") <= quota).drop("_r").withColumn("minutes", played)


SQUAD = FORECASTS + f""", sq AS (SELECT * EXCLUDE (minutes), CASE WHEN slate<=1 THEN 0 ELSE minutes END AS minutes FROM (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY f_exp DESC, entity) AS qr FROM fp) WHERE qr<={QUOTA_SQL})
"""


def lineup_sql(score: str, name: str = "lu") -> str:
    shapes = ", ".join(f"({i},{a},{b},{c})" for i, (a, b, c) in enumerate(d.FORMATIONS))
    inside = "CASE position WHEN 1 THEN pr<=1 WHEN 2 THEN pr<=d WHEN 3 THEN pr<=m ELSE pr<=f END"
    return f""", {name}_r AS (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY {score} DESC, entity) AS pr FROM sq), {name}_f AS (SELECT * FROM (VALUES {shapes}) t(i,d,m,f)),
{name}_v AS (SELECT period, i, round(sum(CASE WHEN {inside} THEN {score} ELSE 0 END),6) AS t, count(*) FILTER ({inside}) AS n FROM {name}_r, {name}_f GROUP BY ALL),
{name}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY t DESC, i) AS k FROM {name}_v WHERE n=11) WHERE k=1),
{name}_x AS (SELECT r.*, coalesce(b.i IS NOT NULL AND ({inside}), false) AS in_xi, t AS xi_score FROM {name}_r r LEFT JOIN {name}_b b ON b.period=r.period LEFT JOIN {name}_f fo ON fo.i=b.i),
{name} AS (SELECT *, in_xi AND row_number() OVER (PARTITION BY period, in_xi ORDER BY {score} DESC, entity)=1 AS captain, in_xi AND row_number() OVER (PARTITION BY period, in_xi ORDER BY {score} DESC, entity)=2 AS vice,
 CASE WHEN NOT in_xi THEN row_number() OVER (PARTITION BY period, in_xi ORDER BY position=1 DESC, {score} DESC, entity) END AS bench_order FROM {name}_x)
"""


LINEUP = SQUAD + lineup_sql("f_base")


def lineups(spark, sf):
    return d.best_lineup(squads(spark, sf), ["period"], "entity", "position", "f_base")


def decision_log(spark, sf):
    """One row per period with arrays of the squad, the eleven and the newcomers, and the captain."""
    lu = lineups(spark, sf)
    log = lu.groupBy("period").agg(
        F.collect_list("entity").alias("squad"), F.collect_list(F.when(F.col("in_xi"), F.col("entity"))).alias("xi"),
        F.max(F.when(F.col("captain"), F.col("entity"))).alias("captain"),
        F.collect_list(F.when(F.col("n_prior") % 5 == 0, F.col("entity"))).alias("moved"),
    )
    return log


@query("D1_exposure_weights", LINEUP + """, fr AS (SELECT period, entity, 0.2e0 AS wt FROM (SELECT period, entity, row_number() OVER (PARTITION BY period, position ORDER BY f_base DESC, entity) AS k FROM fp) WHERE k<=8),
al AS (SELECT * FROM fr UNION ALL SELECT period, entity, 0.5e0 FROM lu UNION ALL SELECT period, entity, 1e0 FROM lu WHERE in_xi UNION ALL SELECT period, entity, 1.5e0 FROM lu WHERE captain UNION ALL SELECT period, entity, 1.25e0 FROM lu WHERE n_prior%5=0), ws AS (SELECT period, entity, sum(wt) AS wt FROM al GROUP BY ALL)
SELECT entity, fp.period, round(coalesce(wt,0),6) AS weight FROM fp LEFT JOIN ws USING (period, entity)""")
def d1(spark, sf):
    out = d.exposure_weights(forecasts(spark, sf), decision_log(spark, sf), ["period"], "position", "entity", "f_base", 8)
    return out.select("entity", "period", r6("weight").alias("weight"))


@query("D2_error_attribution", FORECASTS + f""", x AS (SELECT *, lines/5e0 AS p1, goals/4e0*{GOAL_SQL} AS p2, prob*{CLEAN_SQL} AS p3, bonus/2e0 AS p4, 2e0*slate AS a1, goals*{GOAL_SQL}+3e0*assists AS a2, clean*{CLEAN_SQL}*1e0 AS a3, bonus*1e0 AS a4, CASE WHEN slate<=1 THEN 0 ELSE minutes END AS mi, least(90e0,lines*9e0) AS em, lines/9e0 AS pl FROM fp),
e AS (SELECT *, [abs(p1-a1),abs(p2-a2),abs(p3-a3),abs(p4-a4),abs((f_base-(p1+p2+p3+p4))-(points-(a1+a2+a3+a4)))] AS er FROM x)
SELECT entity, period, CASE WHEN mi-em>=25 THEN 'unexpected minutes' WHEN mi<=0 AND pl>=0.55 THEN 'no-show/availability' WHEN em-mi>=25 THEN 'reduced minutes/benching' ELSE ['minutes/appearance','attacking returns','team clean sheet','bonus','other events'][list_position(er, list_max(er))] END AS cause FROM e""")
def d2(spark, sf):
    from ..functions.scalars import lookup
    goal, clean = lookup(F.col("position"), scoring.GOAL_POINTS), lookup(F.col("position"), scoring.CLEAN_POINTS)
    predicted = {"app": F.col("lines") / 5.0, "att": F.col("goals") / 4.0 * goal, "cs": F.col("prob") * clean, "bon": F.col("bonus") / 2.0}
    actual = {"app": 2.0 * F.col("slate"), "att": F.col("goals") * goal + 3.0 * F.col("assists"), "cs": F.col("clean") * clean, "bon": F.col("bonus") * 1.0}
    predicted["other"] = F.col("f_base") - (predicted["app"] + predicted["att"] + predicted["cs"] + predicted["bon"])
    actual["other"] = F.col("points") - (actual["app"] + actual["att"] + actual["cs"] + actual["bon"])
    names = {"app": "minutes/appearance", "att": "attacking returns", "cs": "team clean sheet", "bon": "bonus", "other": "other events"}
    minutes = F.when(F.col("slate") <= 1, 0).otherwise(F.col("minutes"))
    cause = d.attribute_errors(predicted, actual, minutes, F.least(F.lit(90.0), F.col("lines") * 9.0), F.col("lines") / 9.0, names)
    return forecasts(spark, sf).select("entity", "period", cause.alias("cause"))


@query("D3_best_lineup", LINEUP + "SELECT period, entity, in_xi, captain, vice, CAST(bench_order AS INTEGER) AS bench_order, round(xi_score,6) AS xi_score FROM lu")
def d3(spark, sf):
    return lineups(spark, sf).select("period", "entity", "in_xi", "captain", "vice", "bench_order", r6("xi_score").alias("xi_score"))


def realised_sql(lu: str, score: str, name: str, carry: str = "") -> str:
    """CTEs that walk the bench of each line-up in order; `name` has normal, no_shows and filled."""
    on = "minutes>0"
    fits = "q=b.p OR (q<>1 AND b.p<>1 AND CASE q WHEN 2 THEN n2-1>=3 WHEN 3 THEN n3-1>=2 ELSE n4-1>=1 END)"
    ok = "(played AND spot>0)"
    counts = ", ".join(f"n{k}+CASE WHEN {ok} AND p={k} THEN 1 ELSE 0 END-CASE WHEN {ok} AND ab[spot]={k} THEN 1 ELSE 0 END" for k in (2, 3, 4))
    return f""", {name}_b AS (SELECT period, bench_order AS k, position AS p, {on} AS played, points AS v FROM {lu} WHERE NOT in_xi),
{name}_s AS (SELECT period, coalesce(list(position ORDER BY position, {score} DESC, entity) FILTER (in_xi AND NOT ({on})), []) AS ab, CAST(count(*) FILTER (in_xi AND position=2) AS BIGINT) AS n2, CAST(count(*) FILTER (in_xi AND position=3) AS BIGINT) AS n3, CAST(count(*) FILTER (in_xi AND position=4) AS BIGINT) AS n4,
 sum(CASE WHEN in_xi AND {on} THEN points ELSE 0 END) AS xp, sum(CASE WHEN {on} THEN points ELSE 0 END) AS ap, coalesce(max(CASE WHEN captain AND {on} THEN points END), max(CASE WHEN vice AND {on} THEN points END), 0) AS bonus, count(*) FILTER (in_xi AND NOT ({on})) AS no_shows FROM {lu} GROUP BY period),
{name}_r AS (SELECT period, CAST(0 AS BIGINT) AS k, ab, n2, n3, n4, CAST(0 AS BIGINT) AS gain, CAST(0 AS BIGINT) AS filled FROM {name}_s UNION ALL
 SELECT period, k+1, CASE WHEN {ok} THEN list_concat(ab[1:spot-1], ab[spot+1:]) ELSE ab END, {counts}, gain+CASE WHEN {ok} THEN v ELSE 0 END, filled+CASE WHEN {ok} THEN 1 ELSE 0 END
 FROM (SELECT r.*, b.p, b.played, b.v, coalesce(list_position(list_transform(ab, lambda q: {fits}), true), 0) AS spot FROM {name}_r r JOIN {name}_b b ON b.period=r.period AND b.k=r.k+1) q),
{name}_l AS (SELECT period, max(gain) AS gain, max(filled) AS filled FROM {name}_r GROUP BY period),
{name} AS (SELECT s.period, CAST(xp+gain+bonus AS DOUBLE) AS normal, CAST(ap+bonus AS DOUBLE) AS all_squad, CAST(xp+gain+2*bonus AS DOUBLE) AS triple, CAST(bonus AS DOUBLE) AS captain_bonus, CAST(no_shows AS INTEGER) AS no_shows, CAST(filled AS INTEGER) AS recovered, CAST(no_shows-filled AS INTEGER) AS unfilled FROM {name}_s s JOIN {name}_l l ON l.period=s.period)
"""


RECURSIVE = "WITH RECURSIVE " + LINEUP[5:]


def realised(spark, sf):
    return d.realised_value(lineups(spark, sf), ["period"], "entity", "position", "f_base", "points", "minutes")


@query("D4_realised_value", RECURSIVE + realised_sql("lu", "f_base", "rv") + "SELECT * FROM rv")
def d4(spark, sf):
    return realised(spark, sf)


CAPTAIN = LINEUP + """, xi AS (SELECT * FROM lu WHERE in_xi), rk AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f_base DESC, entity) AS ra, row_number() OVER (PARTITION BY period ORDER BY f_price DESC, entity) AS rb FROM xi),
cb AS (SELECT period, coalesce(max(CASE WHEN minutes>0 THEN points END),0) AS best, max(CASE WHEN ra=1 THEN entity END) AS ca, coalesce(max(CASE WHEN ra=1 AND minutes>0 THEN points END),max(CASE WHEN ra=2 AND minutes>0 THEN points END),0) AS ba, max(CASE WHEN rb=1 THEN entity END) AS cb, coalesce(max(CASE WHEN rb=1 AND minutes>0 THEN points END),max(CASE WHEN rb=2 AND minutes>0 THEN points END),0) AS bb FROM rk GROUP BY period),
cl AS (SELECT period, 'f_base' AS metric, ca AS captain, ba AS bonus, best-ba AS regret, 0 AS change, false AS changed FROM cb UNION ALL SELECT period, 'f_price', cb, bb, best-bb, bb-ba, cb<>ca FROM cb)
"""


def captains(spark, sf):
    xi = lineups(spark, sf).where("in_xi")
    return d.captain_bonus(xi, ["period"], "entity", ["f_base", "f_price"], "points", "minutes")


@query("D5_captain_bonus", CAPTAIN + "SELECT period, metric, captain, CAST(bonus AS DOUBLE) AS bonus, CAST(regret AS DOUBLE) AS regret, CAST(change AS DOUBLE) AS change, changed FROM cl")
def d5(spark, sf):
    return captains(spark, sf)


@query("D5_captain_summary", CAPTAIN + "SELECT metric, round(avg(bonus),6) AS bonus, round(avg(regret),6) AS regret, CAST(sum(change) AS DOUBLE) AS change, count(*) FILTER (changed) AS changed, count(*) FILTER (changed AND change>0) AS positive, count(*) FILTER (changed AND change<0) AS negative FROM cl GROUP BY metric")
def d5b(spark, sf):
    out = d.captain_summary(captains(spark, sf))
    return out.select("metric", r6("bonus").alias("bonus"), r6("regret").alias("regret"), "change", "changed", "positive", "negative")


@query("D6_path_regret", RECURSIVE + realised_sql("lu", "f_base", "rv") + lineup_sql("points", "lb") + realised_sql("lb", "points", "rb")
       + "SELECT rv.period, rv.normal AS taken, rb.normal AS best, rb.normal-rv.normal AS regret FROM rv JOIN rb USING (period)")
def d6(spark, sf):
    return d.path_regret(squads(spark, sf), ["period"], "entity", "position", "f_base", "points", "minutes")


@query("D7_move_gain", SQUAD + """, mv AS (SELECT period, entity, CASE WHEN n_prior%2=0 THEN 1 ELSE -1 END AS sg FROM sq WHERE n_prior%3=0) SELECT mv.period AS decision, CAST(coalesce(sum(p.points*sg),0) AS BIGINT) AS gain FROM mv LEFT JOIN panel p ON p.entity=mv.entity AND p.period BETWEEN mv.period AND mv.period+5 GROUP BY ALL""")
def d7(spark, sf):
    moved = squads(spark, sf).where("n_prior % 3 = 0").groupBy(F.col("period").alias("decision")).agg(
        F.collect_list(F.when(F.col("n_prior") % 2 == 0, F.col("entity"))).alias("in_entities"),
        F.collect_list(F.when(F.col("n_prior") % 2 == 1, F.col("entity"))).alias("out_entities"), F.max("period").alias("period"),
    )
    return d.move_gain(moved, panel(spark, sf), "decision", "period", "entity", "points")


@query("D8_exposure_rates", LINEUP + """, rk AS (SELECT *, rank() OVER (PARTITION BY period, position ORDER BY f_base DESC) AS rk FROM fp), jn AS (SELECT rk.entity, rk.points, rk.rk, lu.entity IS NOT NULL AS own, coalesce(in_xi,false) AS ix, coalesce(captain,false) AS cp FROM rk LEFT JOIN lu ON lu.period=rk.period AND lu.entity=rk.entity WHERE rk.slate>0)
SELECT entity, CAST(sum(points) AS BIGINT) AS total, round(avg(CASE WHEN own THEN 1e0 ELSE 0e0 END),6) AS squad_rate, round(avg(CASE WHEN ix THEN 1e0 ELSE 0e0 END),6) AS xi_rate, round(avg(CASE WHEN cp THEN 1e0 ELSE 0e0 END),6) AS captain_rate, CAST(sum(CASE WHEN own THEN 0 ELSE points END) AS BIGINT) AS omitted, round(avg(rk),6) AS mean_rank FROM jn GROUP BY entity""")
def d8(spark, sf):
    from ..operators.scale import ordered_prefix
    fp = forecasts(spark, sf).withColumn("_neg", -F.col("f_base"))
    place = ordered_prefix(fp, ["period", "position"], "_neg").select("period", "position", "_neg", (F.col("n_before") + 1).alias("rank"))
    facts = fp.join(place, ["period", "position", "_neg"]).where("slate > 0")
    out = d.exposure_rates(facts, decision_log(spark, sf), ["period"], "entity", "points", "rank")
    return out.select("entity", "total", *[r6(c).alias(c) for c in ("squad_rate", "xi_rate", "captain_rate", "mean_rank")], "omitted")


OPPORTUNITY = FORECASTS + """, op AS (SELECT epoch, period, max(f_base) AS sig_a, arg_max(points, f_base*100000-entity) AS gain_a, round(sum(f_price)/count(*),6) AS sig_b, CAST(max(points) AS INTEGER) AS gain_b, count(*) FILTER (slate>=5) AS deep, round(avg(unc),6) AS u FROM fp GROUP BY ALL),
wn AS (SELECT epoch, min(period) AS "start", min(period)+5 AS "end" FROM op GROUP BY epoch UNION ALL SELECT epoch, min(period)+6, max(period) FROM op GROUP BY epoch)
"""


def opportunities(spark, sf):
    return forecasts(spark, sf).groupBy("epoch", "period").agg(
        F.max("f_base").alias("sig_a"), F.max_by("points", F.col("f_base") * 100000 - F.col("entity")).alias("gain_a"),
        r6(F.sum("f_price") / F.count(F.lit(1))).alias("sig_b"), F.max("points").alias("gain_b"),
        F.count(F.when(F.col("slate") >= 5, 1)).alias("deep"), r6(F.avg("unc")).alias("u"),
    )


def windowed(spark, sf):
    op = opportunities(spark, sf)
    first = op.groupBy("epoch").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    spans = F.array(F.struct(F.col("lo").alias("start"), (F.col("lo") + 5).alias("end")), F.struct((F.col("lo") + 6).alias("start"), F.col("hi").alias("end")))
    windows = first.select("epoch", F.explode(spans).alias("_w")).select("epoch", "_w.*")
    return d.opportunity_frame(op, windows, "epoch", "period")


@query("D9_opportunity_frame", OPPORTUNITY + """SELECT op.epoch, period, "start", "end", CAST(row_number() OVER q-1 AS INTEGER) AS index, count(*) OVER (PARTITION BY op.epoch, "start") AS length, round((row_number() OVER q-1)/greatest(1,count(*) OVER (PARTITION BY op.epoch, "start")-1)::DOUBLE,6) AS progress FROM op JOIN wn ON wn.epoch=op.epoch AND period BETWEEN "start" AND "end" WINDOW q AS (PARTITION BY op.epoch, "start" ORDER BY period)""")
def d9(spark, sf):
    return windowed(spark, sf).select("epoch", "period", "start", "end", "index", "length", r6("progress").alias("progress"))


CROSS = OPPORTUNITY + """, j AS (SELECT op.*, "start", "end" FROM op JOIN wn ON wn.epoch=op.epoch AND period BETWEEN "start" AND "end")
"""


@query("D10_first_crossing", CROSS + """, k AS (SELECT epoch, "start", coalesce(min(CASE WHEN deep>=8 AND sig_a>=9 THEN period END), max(CASE WHEN deep>=8 THEN period END), max(period)) AS period, bool_or(deep>=8 AND sig_a>=9) AS crossed FROM j GROUP BY ALL)
SELECT k.epoch, k."start", k.period, round(sig_a,6) AS sig_a, gain_a, crossed FROM k JOIN op ON op.period=k.period""")
def d10(spark, sf):
    out = d.first_crossing(windowed(spark, sf), ["epoch", "start"], "period", "sig_a", F.lit(9.0), F.col("deep") >= 8, ["gain_a"])
    return out.select("epoch", "start", "period", r6("sig_a").alias("sig_a"), "gain_a", "crossed")


@query("D11_resource_schedule", "WITH RECURSIVE " + CROSS[5:] + """, w AS (SELECT epoch, "start", period, sig_a, sig_b, deep, CAST(gain_a AS DOUBLE) AS ga, CAST(gain_b AS DOUBLE) AS gb, row_number() OVER (PARTITION BY epoch, "start" ORDER BY period) AS i FROM j),
o AS (SELECT epoch, "start", period, i, [{'x': sig_b-4.2e0, 's': sig_b, 'n': 'bench', 'g': gb}, {'x': sig_a-9e0, 's': sig_a, 'n': 'captain', 'g': ga}, {'x': deep-15e0, 's': deep*1e0, 'n': 'free', 'g': gb}] AS offers FROM w),
r AS (SELECT epoch, "start", CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, NULL::INTEGER AS period, NULL::STRUCT(x DOUBLE, s DOUBLE, n VARCHAR, g DOUBLE) AS pick FROM (SELECT DISTINCT epoch, "start" FROM o) UNION ALL
 SELECT epoch, "start", i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.n) END, period, best FROM (SELECT o.epoch, o."start", o.i, used, o.period, list_sort(list_filter(offers, lambda f: f.x>=0 AND NOT list_contains(used, f.n)), 'DESC')[1] AS best FROM r JOIN o ON o.epoch=r.epoch AND o."start"=r."start" AND o.i=r.i+1) q)
SELECT epoch, "start", period, pick.n AS resource, round(pick.s,6) AS signal, pick.g AS gain FROM r WHERE pick IS NOT NULL""")
def d11(spark, sf):
    rows = windowed(spark, sf)
    out = d.resource_schedule(rows, ["epoch", "start"], "period", {"bench": "sig_b", "captain": "sig_a", "free": "deep"}, {"bench": "gain_b", "captain": "gain_a", "free": "gain_b"}, {"bench": 4.2, "captain": 9.0, "free": 15.0})
    return out.withColumn("signal", r6("signal"))


@query("D12_expanding_threshold", OPPORTUNITY + """SELECT e.epoch, round(coalesce(quantile_cont(sig_a,0.8),15e0),6) AS threshold FROM (SELECT DISTINCT epoch FROM op) e LEFT JOIN op ON op.epoch<e.epoch AND deep>=8 GROUP BY e.epoch""")
def d12(spark, sf):
    out = d.expanding_threshold(opportunities(spark, sf), "epoch", "sig_a", F.col("deep") >= 8, 0.8, 15.0)
    return out.select("epoch", r6("threshold").alias("threshold"))


@query("D13_reservation_schedule", "WITH RECURSIVE " + CROSS[5:] + """, w AS (SELECT epoch, "start", period, sig_a-0.5e0*(u*(1.15e0-0.35e0*0.8e0)) AS sa, sig_b-0.5e0*(u+1.5e0*1) AS sb, CAST(gain_a AS DOUBLE) AS ga, CAST(gain_b AS DOUBLE) AS gb, row_number() OVER (PARTITION BY epoch, "start" ORDER BY period) AS i, count(*) OVER (PARTITION BY epoch, "start") AS n FROM j),
p AS (SELECT e.epoch, list_sort(list(sa)) AS pa, list_sort(list(sb)) AS pb, stddev_pop(sa) AS da, stddev_pop(sb) AS db FROM (SELECT DISTINCT epoch FROM w) e JOIN w ON w.epoch<e.epoch GROUP BY e.epoch),
f AS (SELECT w.*, m, 0.8e0*greatest(0e0,(n-i+1-m)/n::DOUBLE) AS q, pa, pb, da, db FROM w CROSS JOIN (SELECT unnest([1,2]) AS m) LEFT JOIN p ON p.epoch=w.epoch),
t AS (SELECT *, CASE WHEN pa IS NULL THEN 6e0 ELSE pa[CAST(floor((len(pa)-1)*q) AS BIGINT)+1]+(pa[CAST(ceil((len(pa)-1)*q) AS BIGINT)+1]-pa[CAST(floor((len(pa)-1)*q) AS BIGINT)+1])*((len(pa)-1)*q-floor((len(pa)-1)*q)) END AS ba,
 CASE WHEN pb IS NULL THEN 8e0 ELSE pb[CAST(floor((len(pb)-1)*q) AS BIGINT)+1]+(pb[CAST(ceil((len(pb)-1)*q) AS BIGINT)+1]-pb[CAST(floor((len(pb)-1)*q) AS BIGINT)+1])*((len(pb)-1)*q-floor((len(pb)-1)*q)) END AS bb, CASE WHEN pa IS NULL THEN 4e0 ELSE greatest(1e0,da) END AS ca, CASE WHEN pb IS NULL THEN 4e0 ELSE greatest(1e0,db) END AS cb FROM f),
o AS (SELECT epoch, "start", period, i, m, n-i+1<=m AS must, [{'u': (sb-bb)/cb, 'i': 0, 'n': 'bench', 's': sb, 'b': bb, 'g': gb}, {'u': (sa-ba)/ca, 'i': -1, 'n': 'captain', 's': sa, 'b': ba, 'g': ga}] AS offers FROM t),
r AS (SELECT epoch, "start", CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, NULL::INTEGER AS period, false AS must, NULL::STRUCT(u DOUBLE, i INTEGER, n VARCHAR, s DOUBLE, b DOUBLE, g DOUBLE) AS pick FROM (SELECT DISTINCT epoch, "start" FROM w) UNION ALL
 SELECT epoch, "start", i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.n) END, period, must, best FROM (SELECT o.epoch, o."start", o.i, used, o.period, o.must, list_sort(list_filter(offers, lambda z: (o.must OR z.s>=z.b) AND NOT list_contains(used, z.n)), 'DESC')[1] AS best FROM r JOIN o ON o.epoch=r.epoch AND o."start"=r."start" AND o.i=r.i+1 AND o.m=2-len(used)) q)
SELECT epoch, "start", period, pick.n AS resource, round(pick.s,6) AS score, round(pick.b,6) AS reservation, pick.g AS gain, must AND pick.s<pick.b AS forced FROM r WHERE pick IS NOT NULL""")
def d13(spark, sf):
    rows = windowed(spark, sf).withColumn("score_a", d.hurdle("sig_a", d.risk_proxy("captain", "u", F.lit(0.8)), 0.5))
    rows = rows.withColumn("score_b", d.hurdle("sig_b", d.risk_proxy("bench", "u", blanks=F.lit(1)), 0.5))
    out = d.reservation_schedule(rows, ["epoch", "start"], "epoch", "period", {"bench": "score_b", "captain": "score_a"}, {"bench": "gain_b", "captain": "gain_a"}, {"bench": 8.0, "captain": 6.0}, 0.8)
    return out.withColumn("score", r6("score")).withColumn("reservation", r6("reservation"))


@query("D14_best_in_window", CROSS + """SELECT epoch, "start", arg_max(period, gain_b*1000-period) AS best_period, max(gain_b) AS best_value, arg_max(period, gain_b*1000-period) FILTER (deep>=8) AS structural_period, max(gain_b) FILTER (deep>=8) AS structural_value FROM j GROUP BY ALL""")
def d14(spark, sf):
    return d.best_in_window(windowed(spark, sf), ["epoch", "start"], "period", "gain_b", F.col("deep") >= 8)


@query("D14_best_distinct_pair", CROSS + """, pr AS (SELECT a.epoch, a."start", a.gain_a+b.gain_b AS v, a.period AS p, b.period AS q, row_number() OVER (PARTITION BY a.epoch, a."start" ORDER BY a.gain_a+b.gain_b DESC, a.period, b.period) AS k FROM j a JOIN j b ON a.epoch=b.epoch AND a."start"=b."start" AND a.period<>b.period)
SELECT epoch, "start", v AS value FROM pr WHERE k=1""")
def d14b(spark, sf):
    return d.best_distinct_pair(windowed(spark, sf), ["epoch", "start"], "period", "gain_a", "gain_b").select("epoch", "start", "value")


@query("D15_risk_hurdles", OPPORTUNITY + "SELECT epoch, period, round(u*(1.15e0-0.35e0*0.8e0),6) AS captain_risk, round(u+1.5e0*deep,6) AS bench_risk, round(sig_a-0.5e0*(u*(1.15e0-0.35e0*0.8e0)),6) AS net FROM op")
def d15(spark, sf):
    captain, bench = d.risk_proxy("captain", "u", F.lit(0.8)), d.risk_proxy("bench", "u", blanks="deep")
    return opportunities(spark, sf).select("epoch", "period", r6(captain).alias("captain_risk"), r6(bench).alias("bench_risk"), r6(d.hurdle("sig_a", captain, 0.5)).alias("net"))


@query("D16_availability_summary", RECURSIVE + realised_sql("lu", "f_base", "rv") + """, a AS (SELECT epoch, count(*) AS starters, round(avg(CASE WHEN lines/10e0<0.7 OR lines/8e0<0.84 THEN 1e0 ELSE 0e0 END),6) AS below_floor, count(*) FILTER (lines/8e0<0.7) AS severe, round(avg(CASE WHEN minutes<=0 THEN 1e0 ELSE 0e0 END),6) AS no_show_rate FROM lu WHERE in_xi GROUP BY epoch),
b AS (SELECT epoch, count(*) FILTER (no_shows>0) AS weeks_with_no_show, CAST(sum(recovered) AS BIGINT) AS recovered, CAST(sum(unfilled) AS BIGINT) AS unfilled FROM rv JOIN (SELECT DISTINCT epoch, period FROM lu) USING (period) GROUP BY epoch) SELECT * FROM a JOIN b USING (epoch)""")
def d16(spark, sf):
    lu = lineups(spark, sf)
    starters = lu.where("in_xi").select("epoch", (F.col("lines") / 10.0).alias("start"), (F.col("lines") / 8.0).alias("play"), "minutes")
    values = d.realised_value(lu, ["epoch", "period"], "entity", "position", "f_base", "points", "minutes")
    out = d.availability_summary(starters, values, ["epoch"])
    return out.withColumn("below_floor", r6("below_floor")).withColumn("no_show_rate", r6("no_show_rate"))


@query("D17_variant_comparison", PANEL + ", t AS (SELECT stratum, epoch, CAST(sum(points) AS BIGINT) AS v FROM panel GROUP BY ALL) SELECT t.stratum, t.epoch, t.v AS value, t.v-b.v AS delta FROM t LEFT JOIN t b ON b.stratum='ASIA' AND b.epoch=t.epoch")
def d17(spark, sf):
    totals = panel(spark, sf).groupBy("stratum", "epoch").agg(F.sum("points").alias("total"))
    return d.variant_comparison(totals, "stratum", "epoch", "total", "ASIA")


@query("D18_fieldability", LINEUP + """, x AS (SELECT *, least(1e0,lines/8e0) AS pl, slate=0 OR lines<=2 AS ou FROM lu)
SELECT period, round(sum(CASE WHEN ou THEN 0 ELSE pl END),6) AS expected_squad, round(sum(CASE WHEN in_xi AND NOT ou THEN pl ELSE 0 END),6) AS expected_xi, round(avg(CASE WHEN in_xi THEN CASE WHEN ou THEN 0 ELSE pl END END),6) AS mean_xi, count(*) FILTER (in_xi AND ou) AS out_in_xi, count(*) FILTER (slate>0) AS squad_with_slate, count(*) FILTER (in_xi AND slate>0) AS xi_with_slate FROM x GROUP BY period""")
def d18(spark, sf):
    lu = lineups(spark, sf).withColumn("play", F.least(F.lit(1.0), F.col("lines") / 8.0))
    out = d.fieldability(lu, ["period"], "play", (F.col("slate") == 0) | (F.col("lines") <= 2), "slate", "in_xi")
    return out.select("period", *[r6(c).alias(c) for c in ("expected_squad", "expected_xi", "mean_xi")], "out_in_xi", "squad_with_slate", "xi_with_slate")


@query("D19_legality", SQUAD + """, s AS (SELECT period, side, count(*) AS n FROM sq GROUP BY ALL), m AS (SELECT period, max(n) AS largest_side FROM s GROUP BY period), c AS (SELECT period, count(*) AS size, CAST(sum(price) AS BIGINT) AS cost, count(*) FILTER (position=1)=2 AND count(*) FILTER (position=2)=5 AND count(*) FILTER (position=3)=5 AND count(*) FILTER (position=4)=3 AS quotas FROM sq GROUP BY period)
SELECT period, size, cost, largest_side, quotas, cost<=1250 AS affordable, size=15 AND quotas AND cost<=1250 AND largest_side<=3 AS legal FROM c JOIN m USING (period)""")
def d19(spark, sf):
    return d.legality(squads(spark, sf), ["period"], "entity", "position", "side", "price", F.lit(1250))


@query("D20_affordability", SQUAD + """, b AS (SELECT entity, period, lag(price) OVER (PARTITION BY entity ORDER BY period) AS was FROM panel) SELECT period, CAST(sum(CASE WHEN price<=coalesce(was,price) THEN price ELSE was+(price-was)//2 END)+7 AS BIGINT) AS budget FROM sq JOIN b USING (entity, period) GROUP BY period""")
def d20(spark, sf):
    bought = panel(spark, sf).select("entity", "period", F.lag("price").over(w.timeline("entity", "period")).alias("was"))
    held = squads(spark, sf).join(bought, ["entity", "period"])
    sale = scoring.resale("price", F.coalesce(F.col("was"), F.col("price")))
    return d.affordability(held, ["period"], sale, F.lit(7))


@query("D21_classification_audit", FORECASTS + """, x AS (SELECT prob AS p, points>=5 AS y, unnest(list_filter(['all', CASE WHEN position<=2 THEN 'back' END, CASE WHEN position>=3 THEN 'front' END, CASE WHEN period%12>=6 THEN 'late' END], lambda v: v IS NOT NULL)) AS segment FROM fp)
SELECT segment, count(*) AS rows, round(avg(CASE WHEN y THEN 1e0 ELSE 0e0 END),6) AS positive_rate, round(avg(CASE WHEN (p>=0.5)=y THEN 1e0 ELSE 0e0 END),6) AS accuracy, round(greatest(avg(CASE WHEN y THEN 1e0 ELSE 0e0 END),1-avg(CASE WHEN y THEN 1e0 ELSE 0e0 END)),6) AS majority, round(avg(pow(p-CASE WHEN y THEN 1e0 ELSE 0e0 END,2)),6) AS brier FROM x GROUP BY segment""")
def d21(spark, sf):
    masks = {"back": F.col("position") <= 2, "front": F.col("position") >= 3, "late": F.col("period") % 12 >= 6}
    out = d.classification_audit(forecasts(spark, sf), "prob", F.col("points") >= 5, masks)
    return out.select("segment", "rows", *[r6(c).alias(c) for c in ("positive_rate", "accuracy", "majority", "brier")])
