"""Expanding calibration, ridge, ensembles and selection (inventory group C, first part)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as c
from ..operators import windows as w
from ..sources.scratch import settle
from .bindings import at_last_epoch, FORECASTS, PANEL, forecasts, panel
from .q_windows import label_sql, pct_sql
from .registry import query, r6

KEY = ["entity", "period"]


def hit():
    return F.when(F.col("points") >= 5, 1.0).otherwise(0.0)


def seen():
    return F.col("slate") > 0


HIT_SQL = "CASE WHEN points>=5 THEN 1e0 ELSE 0e0 END"


def iso_sql(sums: str, keys: str, prior: float = 0.12) -> str:
    """CTEs from `sums` (keys, b, n, s dense in b) to `iso` (keys, b, m)."""
    on = " AND ".join(f"x.{k.strip()}=y.{k.strip()}" for k in keys.split(","))
    ky = ", ".join("x." + k.strip() for k in keys.split(","))
    return f""", gg AS (SELECT {keys}, (sum(s)+60*{prior}e0)/(sum(n)+60) AS g FROM {sums} GROUP BY {keys}),
bb AS (SELECT {ky}, b, s+32*g AS v, n+32e0 AS wt FROM {sums} x JOIN gg y ON {on}),
cu AS (SELECT {keys}, b, sum(v) OVER q AS cv, sum(wt) OVER q AS cw, coalesce(sum(v) OVER p,0) AS pv, coalesce(sum(wt) OVER p,0) AS pw FROM bb WINDOW q AS (PARTITION BY {keys} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY {keys} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mm AS (SELECT {ky}, x.b AS a, y.b AS c, (y.cv-x.pv)/(y.cw-x.pw) AS m FROM cu x JOIN cu y ON {on} AND y.b>=x.b),
lo AS (SELECT {keys}, a, b, min(m) AS m FROM mm, range(0,10) t(b) WHERE a<=b AND c>=b GROUP BY ALL),
iso AS (SELECT {keys}, b, least(0.995e0,greatest(0.005e0,max(m))) AS m FROM lo GROUP BY ALL)
"""


#: The events whose probabilities are calibrated: what happened, the raw probability, both in Spark and SQL, and the rate before any deadline.
EVENTS = {
    "return": (lambda: F.col("points") >= 5, "points>=5", lambda: F.col("prob"), "prob", 0.12),
    "blank": (lambda: F.col("points") <= 2, "points<=2", lambda: 1 - F.col("prob"), "(1-prob)", 0.72),
    "haul": (lambda: F.col("points") >= 8, "points>=8", lambda: F.col("prob") / 2, "(prob/2)", 0.045),
}


def cal_sql(event: str) -> str:
    _, happened, _, prob, prior = EVENTS[event]
    bin_ = f"CAST(least(floor({prob}*10),9) AS INTEGER)"
    return FORECASTS + f""", pb AS (SELECT position, period, {bin_} AS b, count(*) AS n, sum(CASE WHEN {happened} THEN 1e0 ELSE 0e0 END) AS s FROM fp GROUP BY ALL),
dl AS (SELECT DISTINCT position, period FROM fp), pr AS (SELECT dl.position, dl.period, t.b, coalesce(sum(n),0) AS n, coalesce(sum(s),0) AS s FROM dl CROSS JOIN range(0,10) t(b) LEFT JOIN pb ON pb.position=dl.position AND pb.period<dl.period AND pb.b=t.b GROUP BY ALL)
""" + iso_sql("pr", "position, period", prior) + f"SELECT entity, fp.period, round(CASE WHEN slate>0 THEN m ELSE 0e0 END,6) AS calibrated FROM fp JOIN iso ON iso.position=fp.position AND iso.period=fp.period AND iso.b={bin_}"


def calibrated_event(spark, sf, event: str):
    happened, _, prob, _, prior = EVENTS[event]
    fp = forecasts(spark, sf).withColumn("raw", prob())
    out = c.expanding_calibration(fp, "position", "raw", F.when(happened(), 1.0).otherwise(0.0), prior, seen(), "calibrated", idle=0.0)
    return out.select(*KEY, r6("calibrated").alias("calibrated"))


@query("C1_expanding_calibration", cal_sql("return"))
def c1(spark, sf):
    return calibrated_event(spark, sf, "return")


@query("C1_expanding_calibration_blank", cal_sql("blank"))
def c1b(spark, sf):
    return calibrated_event(spark, sf, "blank")


@query("C1_expanding_calibration_haul", cal_sql("haul"))
def c1c(spark, sf):
    return calibrated_event(spark, sf, "haul")


@query("C2_terminal_calibration", FORECASTS + f""", pr AS (SELECT position, t.b, count(CASE WHEN CAST(least(floor(prob*10),9) AS INTEGER)=t.b THEN 1 END) AS n, coalesce(sum(CASE WHEN CAST(least(floor(prob*10),9) AS INTEGER)=t.b THEN {HIT_SQL} END),0) AS s FROM fp, range(0,10) t(b) WHERE epoch<(SELECT max(epoch) FROM fp) AND slate>0 GROUP BY ALL)
""" + iso_sql("pr", "position") + "SELECT entity, period, round(m,6) AS calibrated FROM fp JOIN iso ON iso.position=fp.position AND iso.b=CAST(least(floor(prob*10),9) AS INTEGER) WHERE epoch=(SELECT max(epoch) FROM fp)")
def c2(spark, sf):
    out = c.terminal_calibration(*at_last_epoch(forecasts(spark, sf)), "position", "prob", hit(), 0.12, seen(), "calibrated")
    return out.select(*KEY, r6("calibrated").alias("calibrated"))


@query("C3_expanding_half_width", FORECASTS + """, hb AS (SELECT position, period, CAST(least(floor(least(4e0,abs(points-f_base)/greatest(unc,0.1e0))*20),80) AS INTEGER) AS b, count(*) AS n FROM fp GROUP BY ALL), dl AS (SELECT DISTINCT position, period FROM fp),
pr AS (SELECT dl.position, dl.period, b, sum(n) AS n FROM dl JOIN hb ON hb.position=dl.position AND hb.period<dl.period GROUP BY ALL), ru AS (SELECT position, period, b, sum(n) OVER (PARTITION BY position, period ORDER BY b) AS r, sum(n) OVER (PARTITION BY position, period) AS a FROM pr),
rt AS (SELECT position, period, CASE WHEN max(a)>=250 THEN least(2.5e0,greatest(0.25e0,min(CASE WHEN r>=0.8e0*a THEN b END)/20e0)) ELSE 0.7e0 END AS ratio FROM ru GROUP BY ALL)
SELECT entity, period, round(hw,6) AS half_width, round(CASE WHEN slate>0 THEN greatest(0e0,f_base-hw) ELSE 0e0 END,6) AS p10, round(CASE WHEN slate>0 THEN least(25e0,f_base+hw) ELSE 0e0 END,6) AS p90
FROM (SELECT fp.*, least(9e0,greatest(0.4e0,CASE WHEN slate>0 THEN unc*coalesce(ratio,0.7e0) ELSE 0 END)) AS hw FROM fp LEFT JOIN rt ON rt.position=fp.position AND rt.period=fp.period)""")
def c3(spark, sf):
    fp = forecasts(spark, sf)
    out = c.expanding_half_width(fp, "position", F.col("points") - F.col("f_base"), "unc", seen(), centre="f_base")
    return out.select(*KEY, *[r6(x).alias(x) for x in ("half_width", "p10", "p90")])


@query("C3_terminal_half_width", FORECASTS + """, q AS (SELECT position, quantile_cont(least(4e0,abs(points-f_base)/greatest(unc,0.1e0)),0.8) AS ratio FROM fp WHERE slate>0 AND epoch<(SELECT max(epoch) FROM fp) GROUP BY position),
h AS (SELECT fp.*, unc*least(2.5e0,greatest(0.25e0,coalesce(ratio,0.7e0))) AS hw FROM fp LEFT JOIN q USING (position) WHERE epoch=(SELECT max(epoch) FROM fp))
SELECT entity, period, round(hw,6) AS half_width, round(greatest(0e0,f_base-hw),6) AS p10, round(least(25e0,f_base+hw),6) AS p90 FROM h""")
def c3b(spark, sf):
    past, now = at_last_epoch(forecasts(spark, sf))
    out = c.terminal_half_width(past, now, "position", F.col("points") - F.col("f_base"), "unc", "unc", "f_base", seen())
    return out.select(*KEY, *[r6(x).alias(x) for x in ("half_width", "p10", "p90")])


def x1():
    return [F.lit(1.0), F.col("f_base") / 5.0]


def y():
    return F.least(F.greatest(F.col("points"), F.lit(-2)), F.lit(20))


PEN = [0.20, 8.0]
Y_SQL = "least(20,greatest(-2,points))"
MOM = "count(*) AS n, sum({w}1e0) AS g00, sum({w}(f_base/5e0)) AS g01, sum({w}(f_base/5e0)*(f_base/5e0)) AS g11, sum({w}{y}) AS h0, sum({w}{y}*(f_base/5e0)) AS h1"
SUMS = "sum(n) AS n, sum({w}g00) AS g00, sum({w}g01) AS g01, sum({w}g11) AS g11, sum({w}h0) AS h0, sum({w}h1) AS h1"


def cramer(p0: float, p1: float, t: str = "") -> str:
    d = f"(({t}g00+{p0}e0)*({t}g11+{p1}e0)-{t}g01*{t}g01)"
    return f"(({t}h0*({t}g11+{p1}e0)-{t}h1*{t}g01)/{d}+(f_base/5e0)*(({t}g00+{p0}e0)*{t}h1-{t}g01*{t}h0)/{d})"


@query("C4_online_ridge", FORECASTS + f""", ms AS (SELECT position, period, {MOM.format(w='', y=Y_SQL)} FROM fp GROUP BY ALL), dl AS (SELECT DISTINCT position, period FROM fp), pr AS (SELECT dl.position, dl.period, {SUMS.format(w='')} FROM dl JOIN ms ON ms.position=dl.position AND ms.period<dl.period GROUP BY ALL)
SELECT entity, fp.period, round(CASE WHEN slate>0 AND n>=120 THEN least(14e0,greatest(0.15e0,{cramer(0.2, 8.0)})) ELSE f_exp END,6) AS ridge FROM fp LEFT JOIN pr ON pr.position=fp.position AND pr.period=fp.period""")
def c4(spark, sf):
    out = c.online_ridge(forecasts(spark, sf), "position", x1(), y(), "f_exp", seen(), "ridge", PEN)
    return out.select(*KEY, r6("ridge").alias("ridge"))


@query("C5_terminal_ridge", FORECASTS + f""", ms AS (SELECT position, epoch, {MOM.format(w='', y=Y_SQL)} FROM fp WHERE slate>0 AND epoch<(SELECT max(epoch) FROM fp) GROUP BY ALL), pr AS (SELECT position, {SUMS.format(w='pow(0.72e0,(SELECT max(epoch) FROM ms)-epoch)*')} FROM ms GROUP BY ALL)
SELECT entity, period, round(CASE WHEN n>=120 THEN least(14e0,greatest(0.15e0,{cramer(0.2, 8.0)})) ELSE f_exp END,6) AS ridge FROM fp LEFT JOIN pr USING (position) WHERE epoch=(SELECT max(epoch) FROM fp)""")
def c5(spark, sf):
    out = c.terminal_ridge(*at_last_epoch(forecasts(spark, sf)), "position", x1(), y(), "f_exp", seen(), "ridge", PEN)
    return out.select(*KEY, r6("ridge").alias("ridge"))


LABELLED = FORECASTS + f", fl AS (SELECT *, {label_sql(3)} FROM fp WINDOW u AS (PARTITION BY epoch, entity ORDER BY period))"


def labelled(spark, sf, horizons=(3,)):
    fp = forecasts(spark, sf)
    line = w.timeline(["epoch", "entity"], "period")
    for h in horizons:
        total, end = w.forward_label("points", "period", line, h)
        fp = fp.withColumn(f"target{h}", r6(total)).withColumn(f"end{h}", end)
    return fp


YL = "least(55,greatest(-3,target3))"


@query("C6_matured_ridge", LABELLED + f""", ms AS (SELECT position, epoch, end3, {MOM.format(w='', y=YL)} FROM fl GROUP BY ALL), dl AS (SELECT DISTINCT position, epoch, period FROM fp), da AS (SELECT DISTINCT epoch, period FROM fp),
pr AS (SELECT dl.position, dl.period, {SUMS.format(w='')} FROM dl JOIN ms ON ms.position=dl.position AND (ms.epoch<dl.epoch OR (ms.epoch=dl.epoch AND ms.end3<dl.period)) GROUP BY ALL),
pa AS (SELECT da.period, {SUMS.format(w='')} FROM da JOIN ms ON (ms.epoch<da.epoch OR (ms.epoch=da.epoch AND ms.end3<da.period)) GROUP BY ALL)
SELECT entity, fl.period, round(least(52e0,greatest(0.25e0,CASE WHEN coalesce(pa.n,0)<1000 THEN f_exp*2.5e0 WHEN coalesce(pr.n,0)<350 THEN {cramer(0.25, 12.0, 'pa.')} ELSE 0.65e0*{cramer(0.25, 12.0, 'pr.')}+0.35e0*{cramer(0.25, 12.0, 'pa.')} END)),6) AS outlook FROM fl LEFT JOIN pa ON pa.period=fl.period LEFT JOIN pr ON pr.position=fl.position AND pr.period=fl.period""")
def c6(spark, sf):
    fl = labelled(spark, sf).withColumn("base3", F.col("f_exp") * 2.5)
    y = F.least(F.greatest(F.col("target3"), F.lit(-3)), F.lit(55))
    out = c.matured_ridge(fl, "position", x1(), y, "end3", "base3", "outlook", [0.25, 12.0])
    return out.select(*KEY, r6("outlook").alias("outlook"))


@query("C7_inverse_error_weights", FORECASTS + """, e AS (SELECT position, period, avg(CASE WHEN slate>0 THEN abs(f_base-points) END) AS a, avg(CASE WHEN slate>0 THEN abs(f_exp-points) END) AS b, avg(CASE WHEN slate>0 THEN abs(f_price-points) END) AS c FROM fp GROUP BY ALL),
i AS (SELECT position, period, 1/pow(least(6e0,greatest(1.4e0,coalesce(avg(a) OVER q,2.85e0))),2) AS a, 1/pow(least(6e0,greatest(1.4e0,coalesce(avg(b) OVER q,3.05e0))),2) AS b, 1/pow(least(6e0,greatest(1.4e0,coalesce(avg(c) OVER q,3.25e0))),2) AS c FROM e WINDOW q AS (PARTITION BY position ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, fp.period, round(a/(a+b+c),6) AS w_base, round((a*f_base+b*f_exp+c*f_price)/(a+b+c),6) AS ensemble FROM fp JOIN i ON i.position=fp.position AND i.period=fp.period""")
def c7(spark, sf):
    out = c.inverse_error_weights(forecasts(spark, sf), "position", {"f_base": 2.85, "f_exp": 3.05, "f_price": 3.25}, "points", seen())
    mixed = F.col("w_f_base") * F.col("f_base") + F.col("w_f_exp") * F.col("f_exp") + F.col("w_f_price") * F.col("f_price")
    return out.select(*KEY, r6("w_f_base").alias("w_base"), r6(mixed).alias("ensemble"))


ONE = "count(*) AS n, sum(f_base) AS sx, sum(f_base*f_base) AS sxx, sum(target3) AS sy, sum(f_base*target3) AS sxy"
AGED = """ag AS (SELECT position, e.epoch, sum(n) AS n, sum(sx) AS ux, sum(sxx) AS uxx, sum(pow(0.88e0,e.epoch-m.epoch-1)*n) AS wn, sum(pow(0.88e0,e.epoch-m.epoch-1)*sx) AS wx, sum(pow(0.88e0,e.epoch-m.epoch-1)*sxx) AS wxx, sum(pow(0.88e0,e.epoch-m.epoch-1)*sy) AS wy, sum(pow(0.88e0,e.epoch-m.epoch-1)*sxy) AS wxy FROM ms m JOIN (SELECT DISTINCT epoch FROM fp) e ON m.epoch<e.epoch GROUP BY ALL)"""
RIDGE1 = """(wy/wn + (f_base-wx/wn)/sqrt(uxx/n-pow(ux/n,2)) * ((wxy-wx*wy/wn)/sqrt(uxx/n-pow(ux/n,2)))/((wxx-wx*wx/wn)/(uxx/n-pow(ux/n,2))+80))"""


@query("C8_season_ahead_ridge", LABELLED + f""", ms AS (SELECT position, epoch, {ONE} FROM fl WHERE slate>0 GROUP BY ALL), {AGED}
SELECT entity, fl.period, round(CASE WHEN slate=0 THEN 0 WHEN n IS NULL THEN f_exp ELSE least(70e0,greatest(0,{RIDGE1})) END,6) AS h3 FROM fl LEFT JOIN ag ON ag.position=fl.position AND ag.epoch=fl.epoch""")
def c8(spark, sf):
    out = c.season_ahead_ridge(labelled(spark, sf), "position", ["f_base"], ["target3"], seen(), seen(), ["h3"], ["f_exp"])
    return out.select(*KEY, r6("h3").alias("h3"))


@query("C8_season_ahead_ridge_imputed", LABELLED + """, f2 AS (SELECT *, CASE WHEN n_prior%3<>1 THEN f_base END AS late FROM fl), tr AS (SELECT e.epoch AS target, f2.* FROM f2 JOIN (SELECT DISTINCT epoch FROM fp) e ON f2.epoch<e.epoch WHERE slate>0),
md AS (SELECT target, position, coalesce(quantile_cont(late,0.5),0) AS md FROM tr GROUP BY ALL), xs AS (SELECT tr.target, tr.position, coalesce(late,md) AS x, target3 AS y, pow(0.88e0,tr.target-epoch-1) AS w FROM tr JOIN md ON md.target=tr.target AND md.position=tr.position),
ag AS (SELECT target, position, count(*) AS n, sum(x) AS ux, sum(x*x) AS uxx, sum(w) AS wn, sum(w*x) AS wx, sum(w*x*x) AS wxx, sum(w*y) AS wy, sum(w*x*y) AS wxy FROM xs GROUP BY ALL)
SELECT entity, f2.period, round(CASE WHEN slate=0 THEN 0 WHEN n IS NULL THEN f_exp ELSE least(70e0,greatest(0,""" + RIDGE1.replace("f_base", "coalesce(late,md,0)") + """)) END,6) AS h3 FROM f2 LEFT JOIN ag ON ag.position=f2.position AND ag.target=f2.epoch LEFT JOIN md ON md.position=f2.position AND md.target=f2.epoch""")
def c8b(spark, sf):
    fl = labelled(spark, sf).withColumn("late", F.when(F.col("n_prior") % 3 != 1, F.col("f_base")))
    out = c.season_ahead_ridge(fl, "position", ["late"], ["target3"], seen(), seen(), ["h3"], ["f_exp"], impute=True)
    return out.select(*KEY, r6("h3").alias("h3"))


@query("C9_checkpoint_ridge", LABELLED + f""", ms AS (SELECT position, epoch, {ONE} FROM fl WHERE slate>0 GROUP BY ALL), {AGED},
ck AS (SELECT fl.position, fl.epoch, q.c, {ONE} FROM fl JOIN (SELECT unnest([0,4,8]) AS c) q ON end3-epoch*12<q.c WHERE slate>0 GROUP BY ALL),
al AS (SELECT s.position, s.epoch, s.c, coalesce(ag.n,0)+coalesce(ck.n,0) AS n, coalesce(ux,0)+coalesce(sx,0) AS ux, coalesce(uxx,0)+coalesce(sxx,0) AS uxx, coalesce(wn,0)+1.35e0*coalesce(ck.n,0) AS wn, coalesce(wx,0)+1.35e0*coalesce(sx,0) AS wx, coalesce(wxx,0)+1.35e0*coalesce(sxx,0) AS wxx, coalesce(wy,0)+1.35e0*coalesce(sy,0) AS wy, coalesce(wxy,0)+1.35e0*coalesce(sxy,0) AS wxy
 FROM (SELECT DISTINCT position, epoch, c FROM fl, (SELECT unnest([0,4,8]) AS c)) s LEFT JOIN ag ON ag.position=s.position AND ag.epoch=s.epoch LEFT JOIN ck ON ck.position=s.position AND ck.epoch=s.epoch AND ck.c=s.c WHERE s.epoch>0)
SELECT entity, fl.period, round(CASE WHEN slate=0 THEN 0 WHEN n IS NULL THEN f_exp ELSE least(70e0,greatest(0,{RIDGE1})) END,6) AS h3 FROM fl LEFT JOIN al ON al.position=fl.position AND al.epoch=fl.epoch AND al.c=CASE WHEN fl.period-fl.epoch*12>=8 THEN 8 WHEN fl.period-fl.epoch*12>=4 THEN 4 ELSE 0 END""")
def c9(spark, sf):
    fl = labelled(spark, sf).withColumn("step", F.col("period") - F.col("epoch") * 12).withColumn("label_step", F.col("end3") - F.col("epoch") * 12)
    out = c.checkpoint_ridge(fl, "position", ["f_base"], "target3", "label_step", "step", [0, 4, 8], seen(), seen(), "h3", "f_exp")
    return out.select(*KEY, r6("h3").alias("h3"))


@query("C11_blend_search", FORECASTS + """, ls AS (SELECT epoch, i, count(*) AS n, sum(2*(CASE WHEN points>0 THEN points*ln(points/p) ELSE 0 END-(points-p))) AS l FROM (SELECT epoch, points, i, greatest(0.02e0,exp((1-i/20e0)*ln(least(6e0,greatest(0.05e0,f_base)))+(i/20e0)*ln(least(6e0,greatest(0.05e0,f_price))))) AS p FROM fp, range(0,21) t(i)) GROUP BY ALL),
pr AS (SELECT e.epoch, i, sum(n) AS n, round(sum(l),6) AS l FROM (SELECT DISTINCT epoch FROM fp) e JOIN ls ON ls.epoch<e.epoch GROUP BY ALL), bs AS (SELECT epoch, max(n) AS n, arg_min(i, l*1000000+i/1000e0)/20e0 AS wt FROM pr GROUP BY epoch)
SELECT epoch, CAST(coalesce(n,0) AS BIGINT) AS prior_rows, round(CASE WHEN n IS NULL THEN 0.5e0 ELSE n/(n+380e0)*wt+(1-n/(n+380e0))*0.5e0 END,6) AS weight FROM (SELECT DISTINCT epoch FROM fp) LEFT JOIN bs USING (epoch)""")
def c11(spark, sf):
    out = c.blend_search(forecasts(spark, sf), "f_base", "f_price", "points")
    return out.select("epoch", "prior_rows", r6("weight").alias("weight"))


# Members of a squad by position: of so many the advantage is taken.
QUOTAS = {1: 2, 2: 5, 3: 5, 4: 3}


def expert_sql(matured: str, end: str) -> str:
    quota = "CASE position " + " ".join(f"WHEN {p} THEN {n}" for p, n in QUOTAS.items()) + " END"
    return f""", sn AS (SELECT *, row_number() OVER (PARTITION BY position, period ORDER BY f_price DESC, entity) AS a, row_number() OVER (PARTITION BY position, period ORDER BY f_base DESC, entity) AS b FROM fl WHERE slate>0),
ad AS (SELECT position, epoch, period, avg(CASE WHEN a<={quota} THEN target3 END)-avg(CASE WHEN b<={quota} THEN target3 END) AS adv, max({end}) AS fin FROM sn GROUP BY ALL), dl AS (SELECT DISTINCT position, epoch, period FROM fp),
mt AS (SELECT d.position, d.period, adv, row_number() OVER (PARTITION BY d.position, d.period ORDER BY a.period) AS i, count(*) OVER (PARTITION BY d.position, d.period) AS m FROM dl d JOIN ad a ON a.position=d.position AND {matured}),
st AS (SELECT position, period, sum(0.1e0*pow(0.9e0,m-i)*adv) AS state FROM mt GROUP BY ALL)
SELECT position, period, round(coalesce(state,0),6) AS advantage, round(least(0.5e0,greatest(0.05e0,1/(1+exp(-greatest(-18e0,least(18e0,ln(0.25e0/0.75e0)+coalesce(state,0)/2)))))),6) AS weight FROM dl LEFT JOIN st USING (position, period)"""


@query("C12_expert_weights", LABELLED + expert_sql("a.period<d.period", "period"))
def c12(spark, sf):
    out = c.expert_weights(labelled(spark, sf), "position", "f_base", "f_price", "target3", "entity", seen(), 0.9, 2.0, QUOTAS)
    return out.select("position", "period", r6("advantage").alias("advantage"), r6("weight").alias("weight"))


@query("C12_expert_weights_delayed", LABELLED + expert_sql("(a.epoch<d.epoch OR (a.epoch=d.epoch AND a.fin<d.period))", "end3"))
def c12b(spark, sf):
    out = c.expert_weights(labelled(spark, sf), "position", "f_base", "f_price", "target3", "entity", seen(), 0.9, 2.0, QUOTAS, end="end3")
    return out.select("position", "period", r6("advantage").alias("advantage"), r6("weight").alias("weight"))


@query("C13_selection_bias", LABELLED + """, rk AS (SELECT *, CASE WHEN slate>0 THEN row_number() OVER (PARTITION BY position, period, slate>0 ORDER BY f_base DESC, entity) ELSE 99 END AS r FROM fl),
bk AS (SELECT *, CASE WHEN r<=3 THEN 0 WHEN r<=8 THEN 1 WHEN r<=15 THEN 2 WHEN r<=30 THEN 3 ELSE 4 END AS bucket FROM rk), mt AS (SELECT position, epoch, end3, bucket, sum(f_base-target3) AS s, count(*) AS n FROM bk WHERE slate>0 GROUP BY ALL),
dl AS (SELECT DISTINCT position, epoch, period FROM fp), da AS (SELECT DISTINCT epoch, period FROM fp),
po AS (SELECT d.position, d.period, bucket, sum(s) AS s, sum(n) AS n FROM dl d JOIN mt m ON m.position=d.position AND (m.epoch<d.epoch OR (m.epoch=d.epoch AND end3<d.period)) GROUP BY ALL),
ga AS (SELECT d.period, bucket, sum(s) AS s, sum(n) AS n FROM da d JOIN mt m ON (m.epoch<d.epoch OR (m.epoch=d.epoch AND end3<d.period)) GROUP BY ALL),
pm AS (SELECT position, period, sum(s)/sum(n) AS m FROM po GROUP BY ALL), gm AS (SELECT period, sum(s)/sum(n) AS m FROM ga GROUP BY ALL)
SELECT entity, bk.period, bk.bucket, round(CASE WHEN slate=0 THEN 0 ELSE (coalesce(po.s,0)+80*coalesce(ga.s/ga.n,gm.m,0))/(coalesce(po.n,0)+80)-coalesce(pm.m,gm.m,0) END,6) AS bias FROM bk LEFT JOIN po ON po.position=bk.position AND po.period=bk.period AND po.bucket=bk.bucket LEFT JOIN ga ON ga.period=bk.period AND ga.bucket=bk.bucket LEFT JOIN pm ON pm.position=bk.position AND pm.period=bk.period LEFT JOIN gm ON gm.period=bk.period""")
def c13(spark, sf):
    out = c.selection_bias(labelled(spark, sf), "position", "f_base", "target3", "end3", "entity", seen())
    return out.select(*KEY, "bucket", r6("bias").alias("bias"))


STACK = ["f_base", "f_exp", "f_price", "prob"]


def stack_sql() -> str:
    """The best non-negative weights by trying all 15 active sets: an inactive row is an identity row, and Gauss-Jordan steps solve all sets alike."""
    ranks = ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY period, position)<2 THEN 0.5e0 ELSE {pct_sql(x, 'period, position')} END AS {n}" for x, n in [*zip(STACK, ("r1", "r2", "r3", "r4")), ("points", "t")])
    sums = ", ".join([f"sum(w*r{i}) AS s{i}, sum(w*r{i}*t) AS h{i}" for i in range(1, 5)] + [f"sum(w*r{i}*r{j}) AS g{i}{j}" for i in range(1, 5) for j in range(i, 5)])
    a = lambda i, j: f"g{min(i, j)}{max(i, j)}-s{i}*s{j}/sw{'+90' if i == j else ''}"
    on = lambda i: f"(m>>{i - 1})&1=1"
    rows = "[" + ", ".join("[" + ", ".join(f"CASE WHEN {on(i)} AND {on(j)} THEN {a(i, j)} ELSE {'1e0' if i == j else '0e0'} END" for j in range(1, 5)) + f", CASE WHEN {on(i)} THEN h{i}-s{i}*st/sw ELSE 0e0 END]" for i in range(1, 5)) + "]"
    solved = f"SELECT position, epoch, {rows} AS q, [{', '.join(f'h{i}-s{i}*st/sw' for i in range(1, 5))}] AS c FROM ag, range(1,16) k(m)"
    for p in range(1, 5):
        solved = f"SELECT position, epoch, c, list_transform(q, lambda r, i: CASE WHEN i={p} THEN list_transform(r, lambda v: v/r[{p}]) ELSE list_transform(r, lambda v, j: v-r[{p}]*q[{p}][j]/q[{p}][{p}]) END) AS q FROM ({solved})"
    return f""", rk AS MATERIALIZED (SELECT *, {ranks} FROM fp), te AS (SELECT DISTINCT epoch FROM fp WHERE epoch>=3),
ag AS (SELECT position, te.epoch, sum(w) AS sw, sum(w*t) AS st, {sums} FROM (SELECT rk.*, te.epoch AS te, pow(0.88e0,te.epoch-rk.epoch-1) AS w FROM rk JOIN te ON rk.epoch<te.epoch WHERE slate>0) x JOIN te ON te.epoch=x.te GROUP BY ALL),
sv AS (SELECT position, epoch, [q[1][5],q[2][5],q[3][5],q[4][5]] AS x, c FROM ({solved})),
bw AS (SELECT position, epoch, arg_min(x, -list_dot_product(c,x)) AS x FROM sv WHERE list_min(x)>=0 AND list_dot_product(c,x)>2e-12 GROUP BY ALL),
wt AS (SELECT ag.position, ag.epoch, CASE WHEN list_sum(x)>1e-8 THEN list_transform(x, lambda v: v/list_sum(x)) ELSE [0.25e0,0.25e0,0.25e0,0.25e0] END AS x FROM ag LEFT JOIN bw USING (position, epoch)),
sk AS (SELECT rk.*, round(CASE WHEN slate<=0 THEN 0 WHEN x IS NULL THEN r1 ELSE r1*x[1]+r2*x[2]+r3*x[3]+r4*x[4] END,9) AS stack FROM rk LEFT JOIN wt ON wt.position=rk.position AND wt.epoch=rk.epoch),
ka AS (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY stack, entity) AS i FROM sk), kb AS (SELECT period, position, f_base AS v, row_number() OVER (PARTITION BY period, position ORDER BY f_base, entity) AS i FROM fp)
"""


@query("C14_stacked_ranks", FORECASTS + stack_sql() + "SELECT entity, period, round(stack,6) AS stack, round(CASE WHEN slate=0 THEN 0 ELSE v END,6) AS mapped FROM ka JOIN kb USING (period, position, i)")
def c14(spark, sf):
    out = c.stacked_ranks(forecasts(spark, sf), ["period", "position"], "entity", "position", STACK, "points", seen(), seen(), "stack")
    out = settle(out.select(*KEY, "position", "slate", "f_base", F.round("stack", 9).alias("stack")))
    return c.quantile_map(out, ["period", "position"], "entity", "stack", "f_base", "mapped", "slate").select(*KEY, r6("stack").alias("stack"), r6("mapped").alias("mapped"))


QMAP = """, a AS (SELECT *, row_number() OVER (PARTITION BY period, position ORDER BY f_price, entity) AS i FROM fp), b AS (SELECT period, position, f_base AS v, row_number() OVER (PARTITION BY period, position ORDER BY f_base, entity) AS i FROM fp)
"""


@query("C15_quantile_map", FORECASTS + QMAP + "SELECT entity, period, round(CASE WHEN slate=0 THEN 0 ELSE v END,6) AS mapped FROM a JOIN b USING (period, position, i)")
def c15(spark, sf):
    out = c.quantile_map(forecasts(spark, sf), ["period", "position"], "entity", "f_price", "f_base", "mapped", "slate")
    return out.select(*KEY, r6("mapped").alias("mapped"))


@query("C16_rank_consensus", FORECASTS + f""", r AS (SELECT *, {pct_sql('f_base', 'period')} AS a, {pct_sql('f_exp', 'period')} AS b, {pct_sql('f_price', 'period')} AS c FROM fp)
SELECT entity, period, round(CASE WHEN epoch>=2 THEN 0.7e0*a+0.3e0*(b+c)/2-CASE position WHEN 2 THEN 0.02e0 WHEN 1 THEN 0.002e0 ELSE 0 END ELSE a END,6) AS metric FROM r""")
def c16(spark, sf):
    tie = F.when(F.col("position") == 2, 0.02).when(F.col("position") == 1, 0.002).otherwise(0.0)
    out = c.rank_consensus(forecasts(spark, sf), ["period"], "entity", "f_base", ["f_exp", "f_price"], 0.3, tie, F.col("epoch") >= 2, "metric")
    return out.select(*KEY, r6("metric").alias("metric"))


@query("C17_agreement_blend", FORECASTS + """, d AS (SELECT *, f_exp/10-f_base/10 AS a, f_price/10-f_base/10 AS b FROM fp)
SELECT entity, period, round(f_base+CASE WHEN sign(a)=sign(b) AND abs(a)>=0.05 AND period%12+1>=4 THEN 0.4e0*least(1e0,greatest(0,(abs(a)-0.05e0)/0.3e0)) ELSE 0 END*(f_exp-f_base),6) AS plan,
 round(f_base+CASE WHEN greatest((CASE WHEN f_exp>f_base THEN 1 ELSE 0 END+CASE WHEN f_price>f_base THEN 1 ELSE 0 END+CASE WHEN prob*10>f_base THEN 1 ELSE 0 END)/3e0,(CASE WHEN f_exp<f_base THEN 1 ELSE 0 END+CASE WHEN f_price<f_base THEN 1 ELSE 0 END+CASE WHEN prob*10<f_base THEN 1 ELSE 0 END)/3e0)>=0.6 THEN 0.5e0 ELSE 0 END*(list_sort([f_exp,f_price,prob*10])[2]-f_base),6) AS voted FROM d""")
def c17(spark, sf):
    plan = c.agreement_blend("f_base", F.col("f_exp") / 10, F.col("f_base") / 10, F.col("f_price") / 10, "f_exp", F.col("period") % 12 + 1, 0.4, 0.05, 4, True)
    voted, _ = c.vote_blend("f_base", ["f_exp", "f_price", F.col("prob") * 10], 0.5, 0.6)
    return forecasts(spark, sf).select(*KEY, r6(plan).alias("plan"), r6(voted).alias("voted"))


@query("C18_phase_blend", FORECASTS + "SELECT entity, period, round(CASE WHEN period%12+1>=8 THEN 0.75e0*f_base+0.25e0*f_price ELSE f_base END,6) AS plan FROM fp")
def c18(spark, sf):
    plan = c.phase_blend("f_base", "f_price", F.col("period") % 12 + 1, 8, 0.25)
    return forecasts(spark, sf).select(*KEY, r6(plan).alias("plan"))


@query("C21_relevance", FORECASTS + "SELECT entity, period, CAST(least(15,greatest(0,round_even(points/2e0,0))) AS DOUBLE) AS relevance, epoch||'-'||period||'-'||CAST((price+5)//10 AS VARCHAR) AS query_group FROM fp")
def c21(spark, sf):
    return panel(spark, sf).select(
        *KEY, c.relevance(F.col("points") / 2.0).alias("relevance"), c.query_group("epoch", "period", "price", 10, 5).alias("query_group")
    )


@query("C22_residual_band", FORECASTS + """, tr AS (SELECT e.epoch AS target, position, unc, points-f_base AS r FROM fp JOIN (SELECT DISTINCT epoch FROM fp) e ON fp.epoch<e.epoch WHERE slate>0),
ed AS (SELECT target, position, [quantile_cont(unc,0.2),quantile_cont(unc,0.4),quantile_cont(unc,0.6),quantile_cont(unc,0.8)] AS edges FROM tr GROUP BY ALL), bt AS (SELECT tr.target, tr.position, len(list_filter(edges, lambda v: v<unc)) AS bin, r FROM tr JOIN ed ON ed.target=tr.target AND ed.position=tr.position),
bd AS (SELECT target, position, bin, quantile_cont(r,0.1) AS lo, quantile_cont(r,0.9) AS hi FROM bt GROUP BY ALL), ak AS (SELECT fp.*, len(list_filter(edges, lambda v: v<unc)) AS bin FROM fp LEFT JOIN ed ON ed.target=fp.epoch AND ed.position=fp.position)
SELECT entity, period, round(coalesce(lo,-0.8e0*unc),6) AS lower, round(coalesce(hi,0.8e0*unc),6) AS upper FROM ak LEFT JOIN bd ON bd.target=ak.epoch AND bd.position=ak.position AND bd.bin=ak.bin""")
def c22(spark, sf):
    fp = forecasts(spark, sf)
    out = c.residual_band(fp, "position", "unc", F.col("points") - F.col("f_base"), seen())
    return out.select(*KEY, r6("lower").alias("lower"), r6("upper").alias("upper"))


BLENDS = {"a": (1.0, 0.0, 0.0), "b": (0.5, 0.5, 0.0), "c": (0.4, 0.3, 0.3), "d": (0.0, 0.0, 1.0)}


@query("C23_select_blend", FORECASTS + f""", bl AS (SELECT * FROM (VALUES ('a',1e0,0e0,0e0),('b',0.5e0,0.5e0,0e0),('c',0.4e0,0.3e0,0.3e0),('d',0e0,0e0,1e0)) t(blend,w1,w2,w3)),
rw AS (SELECT blend, epoch, period, entity, points AS a, w1*f_base+w2*f_exp+w3*f_price AS f FROM fp, bl WHERE slate>0), er AS (SELECT blend, epoch, sum(abs(f-a)) AS er, count(*) AS n, sum(CASE WHEN a>2 THEN abs(f-a) END) AS he, count(*) FILTER (a>2) AS hn FROM rw GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY blend, period ORDER BY f DESC, entity) AS k, rank() OVER (PARTITION BY blend, period ORDER BY f)+(count(*) OVER (PARTITION BY blend, period, f)-1)/2e0 AS rf, rank() OVER (PARTITION BY blend, period ORDER BY a)+(count(*) OVER (PARTITION BY blend, period, a)-1)/2e0 AS ra FROM rw),
gp AS (SELECT blend, epoch, period, avg(CASE WHEN k<=15 THEN a END) AS top, corr(rf,ra) AS rho FROM rr GROUP BY ALL HAVING count(*)>=20), gs AS (SELECT blend, epoch, sum(top) AS tp, count(*) AS g, sum(CASE WHEN NOT isnan(rho) THEN rho END) AS rho, count(CASE WHEN NOT isnan(rho) THEN rho END) AS rn FROM gp GROUP BY ALL),
pr AS (SELECT e.epoch, er.blend, sum(er) AS er, sum(n) AS n, sum(he) AS he, sum(hn) AS hn, sum(tp) AS tp, sum(g) AS g, sum(rho) AS rho, sum(rn) AS rn FROM (SELECT DISTINCT epoch FROM fp) e JOIN er ON er.epoch<e.epoch AND er.epoch>=1 LEFT JOIN gs ON gs.blend=er.blend AND gs.epoch=er.epoch GROUP BY ALL),
sc AS (SELECT epoch, blend, er/n+0.35e0*coalesce(he/nullif(hn,0),0)-1.2e0*coalesce(rho/nullif(rn,0),0)-0.08e0*coalesce(tp/nullif(g,0),0) AS score FROM pr)
SELECT epoch, arg_min(blend, score) AS blend, round(min(score),6) AS score FROM sc GROUP BY epoch""")
def c23(spark, sf):
    parts = c.blend_scores(forecasts(spark, sf), ["f_base", "f_exp", "f_price"], BLENDS, "points", "entity", seen())
    return c.select_blend(parts).select("epoch", "blend", r6("score").alias("score"))


POLICY = PANEL + ", ps AS (SELECT CAST(side AS VARCHAR) AS policy, epoch, CAST(sum(points) AS DOUBLE) AS total FROM panel GROUP BY ALL)"


def policy_scores(spark, sf):
    return panel(spark, sf).groupBy(F.col("side").cast("string").alias("policy"), "epoch").agg(F.sum("points").cast("double").alias("total"))


@query("C24_nested_choice", POLICY + """, z AS (SELECT *, (total-avg(total) OVER (PARTITION BY epoch))/greatest(stddev_pop(total) OVER (PARTITION BY epoch),1e-6) AS z FROM ps),
s AS (SELECT *, round(avg(z) OVER q-0.25e0*stddev_pop(z) OVER q,9) AS st, count(z) OVER q AS n FROM z WINDOW q AS (PARTITION BY policy ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT policy, round(avg(z)-0.25e0*stddev_pop(z),9) AS sb FROM s WHERE n<2 GROUP BY policy), r AS (SELECT s.*, row_number() OVER (PARTITION BY epoch ORDER BY st DESC, s.policy) AS i, row_number() OVER (PARTITION BY epoch ORDER BY sb DESC, s.policy) AS j FROM s JOIN b ON b.policy=s.policy WHERE n>=2)
SELECT epoch, max(CASE WHEN i=1 THEN policy END) AS selected, max(CASE WHEN i=1 THEN total END) AS points, max(CASE WHEN j=1 THEN policy END) AS static, max(CASE WHEN j=1 THEN total END) AS static_points, max(total) AS oracle_points FROM r GROUP BY epoch""")
def c24(spark, sf):
    return c.nested_choice(policy_scores(spark, sf), "policy", "total")


CANDIDATES = {"a": (0.4, 0.3, 0.2, 0.1), "b": (0.1, 0.2, 0.3, 0.4)}


def cand_sql(name, ws) -> str:
    kept = [0.0 if i == 1 else v for i, v in enumerate(ws)]
    kept = [v / sum(kept) for v in kept]
    fs = ("prob", "f_price/10", "lines/20e0", "slate/10e0")
    dot = "+".join(f"{v!r}::DOUBLE*({f})" for v, f in zip(ws, fs))
    lvl = "0.72e0+0.56e0*(" + "+".join(f"{v!r}::DOUBLE*({f})" for v, f in zip(kept, fs)) + ")"
    return f"SELECT entity, period, '{name}' AS candidate, round({dot},6) AS score, round(f_base*({lvl}),6) AS current, round(f_exp*4*({lvl})-0.1e0*(unc*2)+0.32e0*(bonus/10e0)+0.2e0*prob,6) AS plan FROM fp"


@query("C25_candidate_forecasts", FORECASTS + " UNION ALL ".join(cand_sql(n, ws) for n, ws in CANDIDATES.items()))
def c25(spark, sf):
    fp = forecasts(spark, sf).select(
        *KEY, "prob", (F.col("f_price") / 10).alias("x1"), (F.col("lines") / 20.0).alias("x2"), (F.col("slate") / 10.0).alias("x3"),
        "f_base", (F.col("f_exp") * 4).alias("f4"), "unc", "bonus",
    )
    out = c.candidate_forecasts(fp, ["prob", "x1", "x2", "x3"], CANDIDATES, [1], "f_base", "f4", F.col("unc") * 2, F.col("bonus") / 10.0, F.col("prob"))
    return out.select(*KEY, "candidate", r6("score").alias("score"), r6("current").alias("current"), r6("plan").alias("plan"))


@query("C27_sample_weights", FORECASTS + """, r AS (SELECT *, pow(0.86e0,greatest(7-epoch-1,0))*CASE WHEN points>=8 THEN 1.65e0 WHEN points>=5 THEN 1.25e0 ELSE 1e0 END AS raw FROM fp), m AS (SELECT position, avg(raw) AS mean FROM r GROUP BY position)
SELECT entity, period, round(raw/mean,6) AS weight FROM r JOIN m USING (position)""")
def c27(spark, sf):
    out = c.sample_weights(panel(spark, sf), ["position"], 7 - F.col("epoch"), "points", "weight")
    return out.select(*KEY, r6("weight").alias("weight"))


@query("C28_tenure_target", FORECASTS + f""", fl AS (SELECT *, lines*1e0 AS t, {label_sql(3)}, {label_sql(6)}, {label_sql(10)} FROM fp WINDOW u AS (PARTITION BY epoch, entity ORDER BY period))
SELECT entity, period, round(CASE WHEN t<3 THEN (1-(t-1)/2)*points+(t-1)/2*target3 WHEN t<6 THEN (1-(t-3)/3)*target3+(t-3)/3*target6 WHEN t<10 THEN (1-(t-6)/4)*target6+(t-6)/4*target10 ELSE target10 END,6) AS target, CASE WHEN t>6 THEN end10 WHEN t>3 THEN end6 ELSE end3 END AS matures FROM fl""")
def c28(spark, sf):
    fl = labelled(spark, sf, (3, 6, 10))
    held = F.col("lines").cast("double")
    value, end = c.tenure_target(held, {1: "points", 3: "target3", 6: "target6", 10: "target10"}, {1: "period", 3: "end3", 6: "end6", 10: "end10"})
    return fl.select(*KEY, r6(value).alias("target"), end.alias("matures"))


@query("C29_map_to_reference", FORECASTS + """, fc AS (SELECT * FROM fp WHERE epoch=(SELECT max(epoch) FROM fp)), a AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY f_price, entity*1000+period) AS i, count(*) OVER (PARTITION BY position) AS k FROM fc), b AS (SELECT position, f_base AS v, row_number() OVER (PARTITION BY position ORDER BY f_base, entity*1000+period) AS i FROM fc)
SELECT entity, period, round(v,6) AS mapped, round(100*(i-1)/(k-1)::DOUBLE,6) AS percentile FROM a JOIN b USING (position, i)""")
def c29(spark, sf):
    fc = at_last_epoch(forecasts(spark, sf))[1].withColumn("row_id", F.col("entity") * 1000 + F.col("period"))
    out = c.map_to_reference(fc, ["position"], "row_id", "f_price", "f_base")
    return out.select(*KEY, r6("mapped").alias("mapped"), r6("percentile").alias("percentile"))


@query("C31_top_ensemble", POLICY + """, s AS (SELECT *, round(avg(total) OVER q-0.25e0*stddev_pop(total) OVER q,9) AS st, count(total) OVER q AS n FROM ps WINDOW q AS (PARTITION BY policy ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY st DESC, policy) AS k FROM s WHERE n>0), ch AS (SELECT epoch, policy FROM r WHERE k<=12 UNION ALL SELECT epoch, policy FROM s WHERE n=0 AND policy='7'), pm AS (SELECT CAST(n_nationkey AS VARCHAR) AS policy, n_nationkey/25e0 AS w1, n_regionkey/5e0 AS w2 FROM nation)
SELECT epoch, count(*) AS members, round(avg(w1),6) AS w1, round(avg(w2),6) AS w2 FROM ch JOIN pm USING (policy) GROUP BY epoch""")
def c31(spark, sf):
    from .bindings import table
    parameters = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("policy"), (F.col("n_nationkey") / 25.0).alias("w1"), (F.col("n_regionkey") / 5.0).alias("w2")
    )
    out = c.top_ensemble(policy_scores(spark, sf), "policy", "total", parameters, "7")
    return out.select("epoch", "members", r6("w1").alias("w1"), r6("w2").alias("w2"))
