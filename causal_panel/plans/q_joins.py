"""Joins over the panel (inventory group J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markets
from ..operators import joins as j
from ..operators import windows as w
from ..operators.scale import exact_quantiles
from .bindings import FORECASTS, PANEL, forecasts, panel, table
from .q_windows import SIDES, over, side_panel
from .registry import query, r6

KEY = ["entity", "period"]


@query("J1_dimension_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey")
def j1(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = j.attach_dimension(j.attach_dimension(orders, customer, ["c_custkey"]), nation, ["n_nationkey"])
    return joined.select("o_orderkey", "c_mktsegment", "n_name")


@query("J2_two_roles", PANEL + SIDES + """, lg AS (SELECT epoch, period, avg(scored) AS league FROM side_panel GROUP BY ALL)
SELECT entity, p.period, round(coalesce(a.scored, league),6) AS own_scored, round(coalesce(b.lost, league),6) AS opp_lost FROM panel p JOIN lg ON lg.epoch=p.epoch AND lg.period=p.period LEFT JOIN side_panel a ON a.epoch=p.epoch AND a.period=p.period AND a.side=p.side LEFT JOIN side_panel b ON b.epoch=p.epoch AND b.period=p.period AND b.side=p.opponent""")
def j2(spark, sf):
    sides = side_panel(spark, sf).select("epoch", "period", "side", "scored", "lost")
    both = j.two_roles(panel(spark, sf), sides, ["epoch", "period"], "side", "opponent", "side")
    out = both.join(sides.groupBy("epoch", "period").agg(F.avg("scored").alias("league")), ["epoch", "period"])
    return out.select(*KEY, r6(F.coalesce("own_scored", "league")).alias("own_scored"), r6(F.coalesce("opp_lost", "league")).alias("opp_lost"))


@query("J3_recover_side", """, l AS (""".replace(", l AS (", "WITH l AS (") + """SELECT l_orderkey AS fixture, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(l_suppkey%3 AS INTEGER) AS opp, CAST(l_partkey%3 AS INTEGER) AS snap FROM lineitem),
s AS (SELECT fixture, yr, min(opp) AS a, max(opp) AS b, count(DISTINCT opp) AS n FROM l GROUP BY ALL), r AS (SELECT yr, n, snap, CASE WHEN n=2 THEN CASE WHEN opp=a THEN b ELSE a END ELSE snap END AS side FROM l JOIN s USING (fixture, yr))
SELECT yr, side, count(*) AS "rows", count(*) FILTER (side<>snap) AS recovered, count(*) FILTER (n<>2) AS unresolved FROM r GROUP BY yr, side""")
def j3(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fixture"), F.year("l_shipdate").alias("yr"),
        (F.col("l_suppkey") % 3).cast("int").alias("opp"), (F.col("l_partkey") % 3).cast("int").alias("snap"),
    )
    out = j.recover_side(lines, ["fixture", "yr"], "opp", "snap")
    return out.groupBy("yr", "side").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("recovered"), 1)).alias("recovered"),
        F.count(F.when(~F.col("resolved"), 1)).alias("unresolved"),
    )


@query("J4_dense_spine", PANEL + """, s AS (SELECT * FROM (SELECT DISTINCT epoch, entity FROM panel) JOIN (SELECT DISTINCT epoch, period FROM panel) USING (epoch))
SELECT epoch, entity, period, coalesce(points,0) AS points, coalesce(slate,0) AS slate, coalesce(price,7) AS price FROM s LEFT JOIN panel USING (epoch, entity, period)""")
def j4(spark, sf):
    facts = panel(spark, sf).select("epoch", *KEY, "points", "slate", "price")
    return j.dense_spine(facts, "epoch", "entity", "period", {"points": 0, "slate": 0, "price": 7})


@query("J5_life_spine", PANEL + """, f AS (SELECT * FROM panel WHERE slate>0), s AS (SELECT a.epoch, entity, c.period FROM (SELECT epoch, entity, min(period) AS lo, max(period) AS hi FROM f GROUP BY ALL) a JOIN (SELECT DISTINCT epoch, period FROM f) c ON a.epoch=c.epoch AND c.period BETWEEN lo AND hi)
SELECT epoch, entity, period, points FROM s LEFT JOIN f USING (epoch, entity, period)""")
def j5(spark, sf):
    facts = panel(spark, sf).where(F.col("slate") > 0).select("epoch", *KEY, "points")
    return j.life_spine(facts, "epoch", "entity", "period")


@query("J6_latest_profile", PANEL + "SELECT entity, arg_max(price, period) AS price, arg_max(points, period) AS points FROM panel GROUP BY entity")
def j6(spark, sf):
    return j.latest_profile(panel(spark, sf), "entity", ["epoch", "period"], ["price", "points"])


@query("J6_profile_before", """SELECT o.o_orderkey, (SELECT arg_max(q.o_orderstatus, q.o_orderkey) FROM orders q WHERE q.o_custkey=o.o_custkey AND q.o_orderdate=(SELECT max(z.o_orderdate) FROM orders z WHERE z.o_custkey=o.o_custkey AND z.o_orderdate<o.o_orderdate)) AS last_status FROM orders o""")
def j6b(spark, sf):
    orders = table(spark, sf, "orders")
    # one profile per customer and instant: the highest order key of that instant
    profile = orders.groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    asks = orders.select("o_custkey", "o_orderdate").distinct()
    seen = j.profile_before(profile, asks, "o_custkey", "o_orderdate", ["last_status"], F.year("o_orderdate"))
    return orders.select("o_orderkey", "o_custkey", "o_orderdate").join(seen, ["o_custkey", "o_orderdate"]).select("o_orderkey", "last_status")


@query("J7_covered_lookup", FORECASTS + """, src AS (SELECT epoch, side, opponent, is_home, max(price)/20e0 AS rate FROM panel WHERE price%2=0 GROUP BY ALL),
x AS (SELECT entity, period, coalesce(src.rate IS NOT NULL AND slate=1, false) AS covered, CASE WHEN src.rate IS NOT NULL AND slate=1 THEN src.rate ELSE f_base END AS new_rate FROM fp LEFT JOIN src ON src.epoch=fp.epoch AND src.side=fp.side AND src.opponent=fp.opponent AND src.is_home=fp.is_home)
SELECT entity, period, covered, round(new_rate,6) AS new_rate FROM x""")
def j7(spark, sf):
    keys = ["epoch", "side", "opponent", "is_home"]
    source = panel(spark, sf).where(F.col("price") % 2 == 0).groupBy(*keys).agg((F.max("price") / 20.0).alias("rate"))
    out = j.attach_covered(forecasts(spark, sf), source, keys, F.col("slate") == 1, {"rate": "f_base"})
    return out.select(*KEY, "covered", r6("new_rate").alias("new_rate"))


PAIR_SQL = """, prs AS (SELECT a.period, a.position, (a.points>b.points)=(a.f_base>b.f_base) AND a.f_base<>b.f_base AS good FROM fp a JOIN fp b ON a.period=b.period AND a.position=b.position AND a.entity<b.entity AND abs(a.price-b.price)<=5 AND a.points<>b.points)
"""


@query("J8_near_price_pairs", FORECASTS + PAIR_SQL + "SELECT period, position, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (good) AS BIGINT) AS ordered FROM prs GROUP BY ALL")
def j8(spark, sf):
    return j.near_price_pairs(forecasts(spark, sf), ["period", "position"], "price", "f_base", "points", band=5)


Z_SQL = ", zz AS (SELECT entity, period, side, position, (points-f_base)/greatest(unc,1) AS z FROM fp WHERE slate>0)"


def residuals(spark, sf):
    return forecasts(spark, sf).where(F.col("slate") > 0).select(
        *KEY, "side", "position", ((F.col("points") - F.col("f_base")) / F.greatest("unc", F.lit(1.0))).alias("z")
    )


@query("J9_group_pair_dependence", FORECASTS + Z_SQL + """, p AS (SELECT a.z AS l, b.z AS r, CASE WHEN (a.entity%2=0) AND (b.entity%2=0) THEN 'back' WHEN (a.entity%2=1) AND (b.entity%2=1) THEN 'front' ELSE 'mixed' END AS class FROM zz a JOIN zz b ON a.period=b.period AND a.side=b.side AND a.entity<b.entity)
SELECT class, count(*) AS pairs, round(corr(l,r),6) AS correlation, round(avg(CASE WHEN l<-0.5 AND r<-0.5 THEN 1e0 ELSE 0e0 END),6) AS joint_down, round(avg(CASE WHEN l>0.5 AND r>0.5 THEN 1e0 ELSE 0e0 END),6) AS joint_up FROM p GROUP BY class""")
def j9(spark, sf):
    out = j.pair_dependence(residuals(spark, sf), ["period", "side"], "entity", "z", F.col("entity") % 2 == 0)
    return out.select("class", "pairs", *[r6(c).alias(c) for c in ("correlation", "joint_down", "joint_up")])


@query("J10_adjacent_pairs", FORECASTS + Z_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY entity)-1 AS k FROM zz)
SELECT a.period, a.position, a.k//2 AS pair, round(a.z,6) AS "first", round(b.z,6) AS "second" FROM r a JOIN r b ON a.period=b.period AND a.position=b.position AND a.k%2=0 AND b.k=a.k+1 AND a.side<>b.side""")
def j10(spark, sf):
    out = j.adjacent_pairs(residuals(spark, sf), ["period", "position"], "entity", "side", "z")
    return out.select("period", "position", "pair", r6("first").alias("first"), r6("second").alias("second"))


SLATE = f""", sched AS (SELECT DISTINCT epoch, period, side, opponent, is_home FROM panel),
al AS (SELECT epoch, opponent, position, period, avg(points) AS pa FROM panel GROUP BY ALL), st AS (SELECT epoch, period, position, opponent, avg(pa) {over(None, 'epoch, opponent, position')} AS strength FROM al),
nt AS (SELECT epoch, period, position, quantile_cont(strength,0.5) AS neutral FROM st WHERE strength IS NOT NULL GROUP BY ALL),
cal AS (SELECT epoch, period, row_number() OVER (PARTITION BY epoch ORDER BY period) AS i FROM (SELECT DISTINCT epoch, period FROM panel)),
slots AS (SELECT a.epoch, a.period, b.period AS target, b.i-a.i AS slot, [1e0,0.86e0,0.74e0,0.64e0,0.55e0,0.47e0][b.i-a.i+1] AS weight FROM cal a JOIN cal b ON a.epoch=b.epoch AND b.i BETWEEN a.i AND a.i+5)
"""


def slate_tables(spark, sf):
    p = panel(spark, sf)
    schedule = p.select("epoch", "period", "side", "opponent", "is_home").distinct()
    allowed = p.groupBy("epoch", "opponent", "position", "period").agg(F.avg("points").alias("pa"))
    line = w.timeline(["epoch", "opponent", "position"], "period")
    strength = allowed.select("epoch", "period", "position", "opponent", w.prior_mean("pa", line).alias("strength"))
    neutral = exact_quantiles(strength, ["epoch", "period", "position"], {"neutral": ("strength", 0.5)})
    return p, schedule, strength, neutral


@query("J11_forward_slate", PANEL + SLATE + """, b AS (SELECT DISTINCT epoch, period, side, position FROM panel),
v AS (SELECT b.*, coalesce(neutral,2.5e0) AS nn, slot, weight, s.opponent IS NOT NULL AS pl, coalesce(strength,coalesce(neutral,2.5e0))+CASE WHEN s.is_home THEN 0.18e0 ELSE 0 END AS val FROM b JOIN slots USING (epoch, period) LEFT JOIN sched s ON s.epoch=b.epoch AND s.period=slots.target AND s.side=b.side LEFT JOIN st ON st.epoch=b.epoch AND st.period=b.period AND st.position=b.position AND st.opponent=s.opponent LEFT JOIN nt ON nt.epoch=b.epoch AND nt.period=b.period AND nt.position=b.position),
ps AS (SELECT epoch, period, side, position, nn, slot, weight, coalesce(sum(val) FILTER (pl),0) AS sv, count(*) FILTER (pl) AS n FROM v GROUP BY ALL),
q AS (SELECT epoch, period, side, position, nn, sum(weight*sv) AS wv, sum(weight*n) AS wn, sum(CASE WHEN slot=0 THEN sv ELSE 0 END) AS v0, sum(CASE WHEN slot=0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN slot>0 THEN weight ELSE 0 END) AS wl FROM ps GROUP BY ALL)
SELECT epoch, period, side, position, round(CASE WHEN wn>0 THEN wv/wn ELSE nn END,6) AS outlook, round(greatest(1,wn),6) AS games, round(CASE WHEN n0+wl>0 THEN (v0+wl*nn)/(n0+wl) ELSE nn END,6) AS censored, round(n0+wl,6) AS games_censored FROM q""")
def j11(spark, sf):
    p, schedule, strength, neutral = slate_tables(spark, sf)
    base = p.select("epoch", "period", "side", "position").distinct()
    out = j.forward_slate(base, schedule, strength, neutral)
    return out.select("epoch", "period", "side", "position", *[r6(c).alias(c) for c in ("outlook", "games", "censored", "games_censored")])


@query("J12_newcomers", """WITH n AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS epoch, o_custkey AS entity FROM orders) SELECT epoch, entity FROM n WHERE epoch>(SELECT min(epoch) FROM n) AND NOT EXISTS (SELECT 1 FROM n q WHERE q.epoch=n.epoch-1 AND q.entity=n.entity)""")
def j12(spark, sf):
    """Customers with orders in a year and none in the year before."""
    buyers = table(spark, sf, "orders").select(F.year("o_orderdate").alias("epoch"), F.col("o_custkey").alias("entity"))
    first = buyers.agg(F.min("epoch").alias("_first"))  # one row
    return j.newcomers(buyers, "epoch", "entity").join(F.broadcast(first), F.col("epoch") > F.col("_first")).select("epoch", "entity")


@query("J13_interval_attach", PANEL + """, q AS (SELECT *, period-row_number() OVER (PARTITION BY entity ORDER BY period) AS spell FROM panel WHERE slate<=1),
s AS (SELECT entity, min(period) AS "start", max(period) AS "end" FROM q GROUP BY entity, spell HAVING count(*)>=2),
ev AS (SELECT entity, period, CASE WHEN lines<=2 THEN 'out' WHEN lines<=4 THEN 'limited' ELSE 'fit' END AS status FROM panel WHERE lines<>5)
SELECT s.entity, s."start", s."end", count(status) AS events, count(*) FILTER (status='out') AS bad_events, coalesce(bool_or(status='out'),false) AS explained FROM s LEFT JOIN ev ON ev.entity=s.entity AND ev.period BETWEEN s."start" AND s."end" GROUP BY ALL""")
def j13(spark, sf):
    p = panel(spark, sf)
    runs = w.spells(p, "entity", "period", F.col("slate") <= 1, 2)
    spans = runs.groupBy("entity", "spell").agg(F.min("period").alias("start"), F.max("period").alias("end")).drop("spell")
    status = F.when(F.col("lines") <= 2, "out").when(F.col("lines") <= 4, "limited").otherwise("fit")
    events = p.where(F.col("lines") != 5).select(*KEY, status.alias("status"))
    return j.attach_interval(spans, events, ["entity"], "start", "end", "period", "status", ["out"])


@query("J14_best_name_match", """WITH a AS (SELECT p_partkey, p_type, p_brand, CASE p_partkey%3 WHEN 0 THEN substr(split_part(p_name,' ',1),1,1)||'.'||split_part(p_name,' ',2) WHEN 1 THEN split_part(p_name,' ',2) ELSE reverse(substr(reverse(p_name),3)) END AS short FROM part),
k AS (SELECT DISTINCT p_type, p_name AS match, p_brand AS match_side FROM part WHERE p_partkey%5<>0),
n AS (SELECT *, regexp_replace(lower(short),'[^a-z0-9]','','g') AS s FROM a), m AS (SELECT *, regexp_replace(lower(match),'[^a-z0-9]','','g') AS f FROM k),
d AS (SELECT DISTINCT n.p_type, s, f FROM n JOIN m ON n.p_type=m.p_type),
e AS (SELECT *, CASE WHEN s=f THEN 1e0 WHEN contains(f,s) THEN 0.94e0 WHEN length(s)>=4 AND ends_with(f,substr(s,2)) AND s[1]=f[1] THEN 0.92e0 ELSE 1-levenshtein(s,f)/greatest(length(s),length(f))::DOUBLE END AS sim FROM d),
x AS (SELECT p_partkey, n.p_type, match, match_side, sim+CASE WHEN contains(lower(match_side),lower(p_brand)) OR contains(lower(p_brand),lower(match_side)) THEN 0.1e0 ELSE 0 END AS sc FROM n JOIN e ON e.p_type=n.p_type AND e.s=n.s JOIN m ON m.p_type=e.p_type AND m.f=e.f),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sc DESC, match, match_side) AS rn FROM x)
SELECT p_partkey, match, match_side, round(least(1,sc),6) AS score FROM r WHERE rn=1 AND sc>=0.68""")
def j14(spark, sf):
    part = table(spark, sf, "part")
    words = F.split("p_name", " ")
    short = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(words[0], 1, 1), F.lit("."), words[1]))
        .when(F.col("p_partkey") % 3 == 1, words[1]).otherwise(F.expr("substr(p_name, 1, length(p_name) - 2)"))
    )
    asked = part.select("p_partkey", "p_type", "p_brand", short.alias("short"))
    known = part.where(F.col("p_partkey") % 5 != 0).select("p_type", "p_name", "p_brand")
    out = j.best_name_match(asked, known, ["p_type"], "p_partkey", "short", "p_brand", "p_name", "p_brand")
    return out.select("p_partkey", "match", "match_side", r6("score").alias("score"))


REPLACE = """, ow AS (SELECT *, price-2 AS sale_price, 4 AS bank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f_exp DESC, entity) AS rk FROM fp) WHERE rk<=15),
pr AS (SELECT o.period, o.entity, o.f_base AS score, m.entity AS ie, m.price AS ip, m.f_base AS isc, m.side AS iside, o.side AS oside FROM ow o JOIN fp m ON o.period=m.period AND o.position=m.position AND m.slate>0 AND m.price<=o.sale_price+o.bank WHERE NOT EXISTS (SELECT 1 FROM ow z WHERE z.period=o.period AND z.entity=m.entity)),
ok AS (SELECT * FROM pr WHERE iside=oside OR (SELECT count(*) FROM ow z WHERE z.period=pr.period AND z.side=pr.iside)<3),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, entity ORDER BY isc DESC, ie) AS rn FROM ok) WHERE rn=1)
"""


def replacements(spark, sf):
    fp = forecasts(spark, sf)
    owned = w.top_k(fp, ["period"], [F.desc("f_exp"), F.asc("entity")], 15).select(
        F.col("period").alias("decision"), "period", "entity", "position", "side", (F.col("price") - 2).alias("sale_price"),
        F.lit(4).alias("bank"), F.col("f_base").alias("score"),
    )
    market = fp.select("period", "entity", "position", "side", "price", F.col("f_base").alias("score"), "slate")
    return j.best_replacement(owned, market, "decision", "period")


@query("J15_best_replacement", FORECASTS + REPLACE + "SELECT period, entity, ie AS replacement, ip AS price, round(isc-score,6) AS gain FROM rb")
def j15(spark, sf):
    return replacements(spark, sf).select("period", "entity", "replacement", "price", r6("gain").alias("gain"))


@query("J16_distinct_suggestions", FORECASTS + REPLACE + """, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, ie ORDER BY isc-score DESC, entity) AS r1 FROM rb WHERE isc-score>=1.5) WHERE r1=1)
SELECT period, entity, replacement, gain, place FROM (SELECT period, entity, ie AS replacement, round(isc-score,6) AS gain, CAST(row_number() OVER (PARTITION BY period ORDER BY isc-score DESC, entity) AS INTEGER) AS place FROM u) WHERE place<=3""")
def j16(spark, sf):
    out = j.distinct_suggestions(replacements(spark, sf), "decision")
    return out.select(F.col("decision").alias("period"), "entity", "replacement", r6("gain").alias("gain"), "place")


def grid_sql(step: float, size: int) -> str:
    return f""", g1 AS (SELECT i, 0.25e0+{step}e0*i AS r FROM range(0,{size}) t(i)), ms AS (SELECT i, r, k, exp(-r)*pow(r,k)/factorial(k::INTEGER) AS m FROM g1, range(0,11) q(k)),
jt AS (SELECT a.i AS hi, b.i AS ai, a.r AS hr, b.r AS ar, sum(CASE WHEN a.k>b.k THEN a.m*b.m ELSE 0 END) AS h, sum(CASE WHEN a.k=b.k THEN a.m*b.m ELSE 0 END) AS d, sum(CASE WHEN a.k<b.k THEN a.m*b.m ELSE 0 END) AS w FROM ms a, ms b GROUP BY ALL),
grid AS (SELECT hi*{size}+ai AS ix, hr, ar, h/(h+d+w) AS h, d/(h+d+w) AS d, w/(h+d+w) AS w FROM jt)
"""


@query("J17_fit_odds", PANEL + """, o0 AS (SELECT entity, period, 1/greatest(1+goals/2e0,1.001e0) AS a, 1/greatest(1+assists/2e0,1.001e0) AS b, 1/greatest(1+clean/4e0,1.001e0) AS c FROM panel),
o1 AS (SELECT entity, period, round(a/(a+b+c),2) AS hp, round(b/(a+b+c),2) AS dp, round(c/(a+b+c),2) AS ap FROM o0)""" + grid_sql(0.04, 88) + """, dd AS (SELECT DISTINCT hp, dp, ap FROM o1),
ls AS (SELECT hp, dp, ap, arg_min({'h': hr, 'a': ar}, pow(h-hp,2)+pow(d-dp,2)+pow(w-ap,2)) AS best FROM dd, grid GROUP BY ALL)
SELECT entity, period, round(best.h,6) AS home_rate, round(best.a,6) AS away_rate FROM o1 JOIN ls USING (hp, dp, ap)""")
def j17(spark, sf):
    home, draw, away = markets.no_vig([1 + F.col("goals") / 2.0, 1 + F.col("assists") / 2.0, 1 + F.col("clean") / 4.0])
    odds = panel(spark, sf).select(*KEY, F.round(home, 2).alias("hp"), F.round(draw, 2).alias("dp"), F.round(away, 2).alias("ap"))
    return j.fit_odds(odds, "hp", "dp", "ap").select(*KEY, r6("home_rate").alias("home_rate"), r6("away_rate").alias("away_rate"))


@query("J18_blend_match_rates", FORECASTS + """, mk AS (SELECT entity, period, round((goals+1)/(lines+3e0),2) AS h, round((assists+1)/(lines+3e0),2) AS d, round(1-(goals+1)/(lines+3e0)-(assists+1)/(lines+3e0),2) AS a, slate/5e0 AS q FROM fp WHERE lines%2=0),
pb AS (SELECT entity, period, round((clean+1)/(2*lines+3e0),2) AS h, 0.25e0 AS d, round(0.75e0-(clean+1)/(2*lines+3e0),2) AS a FROM fp WHERE lines%3=0),
jn AS (SELECT fp.entity, fp.period, f_base/3 AS hf, f_price/3 AS af, prob AS hw, mk.h AS mh, q, CASE WHEN mk.h IS NOT NULL AND pb.h IS NOT NULL THEN 0.7e0*mk.h+0.3e0*pb.h ELSE coalesce(mk.h,pb.h) END AS eh, CASE WHEN mk.h IS NOT NULL AND pb.h IS NOT NULL THEN 0.7e0*mk.d+0.3e0*pb.d ELSE coalesce(mk.d,pb.d) END AS ed,
 CASE WHEN mk.h IS NOT NULL AND pb.h IS NOT NULL THEN 0.7e0*mk.a+0.3e0*pb.a ELSE coalesce(mk.a,pb.a) END AS ea FROM fp LEFT JOIN mk USING (entity, period) LEFT JOIN pb USING (entity, period))""" + grid_sql(0.04, 88) + """, dd AS (SELECT DISTINCT eh, ed, ea FROM jn WHERE eh IS NOT NULL),
ls AS (SELECT eh, ed, ea, arg_min({'h': hr, 'a': ar}, pow(h-eh,2)+pow(d-ed,2)+pow(w-ea,2)) AS best FROM dd, grid GROUP BY ALL),
f AS (SELECT jn.*, coalesce(least(0.82e0,greatest(0,0.92e0*q)),0) AS wt, best.h AS hr, best.a AS ar FROM jn LEFT JOIN ls USING (eh, ed, ea))
SELECT entity, period, round(wt,6) AS weight, round(CASE WHEN hr IS NULL THEN hf ELSE (1-wt)*hf+wt*hr END,6) AS home, round(CASE WHEN ar IS NULL THEN af ELSE (1-wt)*af+wt*ar END,6) AS away, round(exp(-CASE WHEN ar IS NULL THEN af ELSE (1-wt)*af+wt*ar END),6) AS home_clean, round(exp(-CASE WHEN hr IS NULL THEN hf ELSE (1-wt)*hf+wt*hr END),6) AS away_clean, round(hw-mh,6) AS market_gap, round(hw-eh,6) AS outside_gap FROM f""")
def j18(spark, sf):
    fp = forecasts(spark, sf)
    g, a = (F.col("goals") + 1) / (F.col("lines") + 3.0), (F.col("assists") + 1) / (F.col("lines") + 3.0)
    c = (F.col("clean") + 1) / (2 * F.col("lines") + 3.0)
    market = fp.where(F.col("lines") % 2 == 0).select(
        *KEY, F.round(g, 2).alias("home_p"), F.round(a, 2).alias("draw_p"), F.round(1 - g - a, 2).alias("away_p"), (F.col("slate") / 5.0).alias("quality")
    )
    published = fp.where(F.col("lines") % 3 == 0).select(
        *KEY, F.round(c, 2).alias("home_p"), F.lit(0.25).alias("draw_p"), F.round(0.75 - c, 2).alias("away_p")
    )
    matches = fp.select(*KEY, (F.col("f_base") / 3).alias("home_for"), (F.col("f_price") / 3).alias("away_for"), F.col("prob").alias("home_win"))
    out = j.blend_match_rates(matches, market, published, KEY)
    return out.select(*KEY, *[r6(x).alias(x) for x in ("weight", "home", "away", "home_clean", "away_clean", "market_gap", "outside_gap")])


@query("J19_forward_rates", PANEL + SLATE + """, rt AS (SELECT epoch, period, side, opponent, is_home, avg(points)/4 AS ef, avg(conceded)/2 AS eg FROM panel GROUP BY ALL), nw AS (SELECT epoch, period, side, avg(goals) AS ef, avg(bonus) AS eg FROM panel WHERE slate>1 GROUP BY ALL),
t AS (SELECT b.epoch, b.period, b.side, slot, weight, s.opponent, s.is_home FROM (SELECT DISTINCT epoch, period, side FROM sched) b JOIN slots USING (epoch, period) JOIN sched s ON s.epoch=b.epoch AND s.period=slots.target AND s.side=b.side),
v AS (SELECT t.epoch, t.period, t.side, weight, coalesce(CASE WHEN slot=0 THEN coalesce(nw.ef,rt.ef) ELSE rt.ef END,1.4e0) AS ef, coalesce(CASE WHEN slot=0 THEN coalesce(nw.eg,rt.eg) ELSE rt.eg END,1.4e0) AS eg FROM t LEFT JOIN rt ON rt.epoch=t.epoch AND rt.period=t.period AND rt.side=t.side AND rt.opponent=t.opponent AND rt.is_home=t.is_home LEFT JOIN nw ON nw.epoch=t.epoch AND nw.period=t.period AND nw.side=t.side)
SELECT epoch, period, side, round(sum(weight*ef)/sum(weight),6) AS expected_for, round(sum(weight*eg)/sum(weight),6) AS expected_against FROM v GROUP BY ALL""")
def j19(spark, sf):
    p = panel(spark, sf)
    schedule = p.select("epoch", "period", "side", "opponent", "is_home").distinct()
    rates = p.groupBy("epoch", "period", "side", "opponent", "is_home").agg(
        (F.avg("points") / 4).alias("expected_for"), (F.avg("conceded") / 2).alias("expected_against")
    )
    now = p.where(F.col("slate") > 1).groupBy("epoch", "period", "side").agg(F.avg("goals").alias("expected_for"), F.avg("bonus").alias("expected_against"))
    out = j.forward_rates(schedule, rates, now, {"expected_for": 1.4, "expected_against": 1.4})
    return out.select("epoch", "period", "side", r6("expected_for").alias("expected_for"), r6("expected_against").alias("expected_against"))
