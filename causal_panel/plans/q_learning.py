"""Walk-forward fits with MLlib (inventory group C, second part)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.markets import no_vig
from ..operators import learning as m
from ..operators.estimators import quantile_map, relevance
from ..operators.isotonic import expanding_isotonic
from ..operators.newton import glm_sql, predict_sql
from ..sources.scratch import settle
from .bindings import FORECASTS, forecasts
from .q_decisions import opportunities
from .registry import query, r6

KEY = ["entity", "period"]


def seen():
    return F.col("slate") > 0


@query("C10_walk_forward_isotonic", FORECASTS + """, ep AS (SELECT DISTINCT epoch FROM fp), pt AS (SELECT position, e.epoch, f_base AS x, sum(greatest(points,0)) AS s, count(*) AS w FROM fp JOIN ep e ON fp.epoch<e.epoch WHERE slate>0 GROUP BY ALL),
ok AS (SELECT position, epoch FROM pt GROUP BY ALL HAVING sum(w)>=250), cu AS (SELECT position, epoch, x, row_number() OVER q AS i, sum(s) OVER q AS cs, sum(w) OVER q AS cw, sum(s) OVER q-s AS ps, sum(w) OVER q-w AS pw FROM pt SEMI JOIN ok USING (position, epoch) WINDOW q AS (PARTITION BY position, epoch ORDER BY x ROWS UNBOUNDED PRECEDING)),
mm AS (SELECT position, epoch, a.i AS a, c.i AS c, c.x, (c.cs-a.ps)/(c.cw-a.pw)::DOUBLE AS m FROM cu a JOIN cu c USING (position, epoch) WHERE c.i>=a.i),
lo AS (SELECT position, epoch, c AS b, x, min(m) OVER (PARTITION BY position, epoch, a ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS m FROM mm), iso AS (SELECT position, epoch, x, max(m) AS v FROM lo GROUP BY ALL),
nx AS (SELECT *, lead(x) OVER q AS x2, lead(v) OVER q AS v2, row_number() OVER q=1 AS first FROM iso WINDOW q AS (PARTITION BY position, epoch ORDER BY x)),
st AS (SELECT position, epoch, min(x) AS x0, arg_min(v,x) AS v0 FROM iso GROUP BY ALL),
hit AS (SELECT fp.*, nx.x, nx.v, nx.x2, nx.v2 FROM fp ASOF LEFT JOIN nx ON nx.position=fp.position AND nx.epoch=fp.epoch AND fp.f_base>=nx.x)
SELECT entity, period, round(CASE WHEN slate<=0 THEN 0 WHEN v0 IS NULL THEN f_base WHEN hit.x IS NULL THEN v0 WHEN x2 IS NULL THEN v ELSE v+(v2-v)*(f_base-hit.x)/(x2-hit.x) END,6) AS calibrated FROM hit LEFT JOIN st ON st.position=hit.position AND st.epoch=hit.epoch""")
def c10(spark, sf):
    fp = settle(forecasts(spark, sf).select(*KEY, "epoch", "position", "slate", "points", "f_base"))
    return expanding_isotonic(fp, "position", "f_base", "points", seen(), "calibrated").select(*KEY, r6("calibrated").alias("calibrated"))


@query("C19_walk_forward_trees")
def c19(spark, sf):
    fp = settle(forecasts(spark, sf).select(*KEY, "epoch", "position", "slate", "points", "f_base", "f_exp", "f_price", F.col("n_prior").cast("double").alias("n_prior")))
    out = m.walk_forward_trees(fp, ["f_base", "f_exp", "f_price", "n_prior"], "points", seen(), "f_base", "tree", "points", high=14.0, trees=8, labels=(-2.0, 20.0))
    return out.select(*KEY, r6("tree").alias("tree"))


MARKET = ["win", "draw", "loss", "over", "total", "ratio", "home", "win_over", "loss_over"]
FIRST = 4


def sides(spark, sf):
    """Both chances, the total and their products, as a book would quote them."""
    win, draw, loss = no_vig([1 + F.col("goals") / 2.0, 1 + F.col("assists") / 2.0, 1 + F.col("clean") / 4.0])
    fp = forecasts(spark, sf).select(*KEY, "epoch", win.alias("win"), draw.alias("draw"), loss.alias("loss"), ((F.col("conceded") + 1) / (F.col("conceded") + F.col("bonus") + 3.0)).alias("over"),
                                     (F.col("saves") / 10.0).alias("total"), F.col("is_home").cast("double").alias("home"), F.col("bonus").alias("scored"), (F.col("conceded") == 0).alias("clean"))
    return fp.withColumn("ratio", F.log(F.greatest("win", F.lit(0.01)) / F.greatest("loss", F.lit(0.01)))).withColumn("win_over", F.col("win") * F.col("over")).withColumn("loss_over", F.col("loss") * F.col("over"))


BOOK = FORECASTS + """, bk AS (SELECT *, 1/greatest(1+goals/2e0,1.001e0) AS a, 1/greatest(1+assists/2e0,1.001e0) AS b, 1/greatest(1+clean/4e0,1.001e0) AS c FROM fp),
b2 AS (SELECT entity, period, epoch, a/(a+b+c) AS win, b/(a+b+c) AS draw, c/(a+b+c) AS loss, (conceded+1)/(conceded+bonus+3e0) AS over, saves/10e0 AS total, CAST(is_home AS INTEGER) AS home, bonus AS _scored, CAST(conceded=0 AS INTEGER) AS _clean FROM bk),
tr AS MATERIALIZED (SELECT *, ln(greatest(win,0.01)/greatest(loss,0.01)) AS ratio, win*over AS win_over, loss*over AS loss_over FROM b2), tg AS (SELECT DISTINCT epoch FROM tr WHERE epoch>=4)
"""
REVERSED = ["loss", "draw", "win", "over", "total", "(-ratio)", "(1-home)", "loss_over", "win_over"]


@query("C20_market_model", "WITH RECURSIVE " + BOOK[5:] + ", " + glm_sql("tr", "tg", MARKET, m.market_models()) + f""", pr AS (SELECT tr.*, {predict_sql(MARKET, "poisson", "g")} AS ef, {predict_sql(REVERSED, "poisson", "g")} AS ea, {predict_sql(MARKET, "logistic", "c")} AS lg
 FROM tr LEFT JOIN fits g ON g.epoch=tr.epoch AND g.model='goals' LEFT JOIN fits c ON c.epoch=tr.epoch AND c.model='clean')
SELECT entity, period, round(least(4.2e0,greatest(0.2e0,ef)),6) AS expected_for, round(least(4.2e0,greatest(0.2e0,ea)),6) AS expected_against, round(least(0.8e0,greatest(0.02e0,0.55e0*exp(-least(4.2e0,greatest(0.2e0,ea)))+0.45e0*lg)),6) AS clean_chance FROM pr""".replace("least(4.2e0,greatest(0.2e0,ef))", "CASE WHEN ef IS NOT NULL THEN least(4.2e0,greatest(0.2e0,ef)) END").replace("round(least(4.2e0,greatest(0.2e0,ea)),6)", "round(CASE WHEN ea IS NOT NULL THEN least(4.2e0,greatest(0.2e0,ea)) END,6)").replace("round(least(0.8e0", "round(CASE WHEN lg IS NOT NULL THEN least(0.8e0").replace("0.45e0*lg)),6)", "0.45e0*lg)) END,6)"))
def c20(spark, sf):
    swapped = {"win": F.col("loss"), "loss": F.col("win"), "home": 1 - F.col("home"), "ratio": -F.col("ratio"), "win_over": F.col("loss_over"), "loss_over": F.col("win_over")}
    out = m.market_model(settle(sides(spark, sf)), MARKET, swapped, "scored", F.col("clean"), FIRST)
    return out.select(*KEY, r6("expected_for").alias("expected_for"), r6("expected_against").alias("expected_against"), r6("clean_chance").alias("clean_chance"))


@query("C21_relevance_ranking")
def c21(spark, sf):
    """Trees on the relevance label, given the reference's scale within each deadline and stratum."""
    fp = forecasts(spark, sf).select(*KEY, "epoch", "position", "slate", "points", "f_base", "f_exp", "f_price").withColumn("label", relevance(F.col("points")))
    ranked = m.walk_forward_trees(settle(fp), ["f_base", "f_exp", "f_price"], "label", seen(), "f_base", "rank_score", "points", trees=5, depth=3)
    out = quantile_map(settle(ranked), ["period", "position"], "entity", "rank_score", "f_base", "mapped", "slate")
    return out.select(*KEY, r6("mapped").alias("mapped"))


def fitted_actions(spark, sf):
    fp = settle(forecasts(spark, sf).where(seen()).select(
        *KEY, "epoch", "f_base", "f_exp", "f_price", (F.col("points") - F.col("f_exp")).alias("gain")
    ))
    return m.action_fits(fp, ACTION, "gain")


ACTION = ["f_base", "f_exp", "f_price"]
ACTIONS = "WITH RECURSIVE " + FORECASTS[5:] + """, tr AS MATERIALIZED (SELECT entity, period, epoch, f_base, f_exp, f_price, points-f_exp AS gain, least(35e0,greatest(-35e0,points-f_exp)) AS _gain, CAST(points-f_exp>0 AS INTEGER) AS _win, 1+0.03e0*least(abs(least(35e0,greatest(-35e0,points-f_exp))),20) AS _load FROM fp WHERE slate>0), tg AS (SELECT DISTINCT epoch FROM tr), """ + glm_sql("tr", "tg", ACTION, m.action_models(), least=250) + f""",
lm AS (SELECT a.epoch, quantile_cont(abs({predict_sql(ACTION, "gaussian", "a")}-({predict_sql(ACTION, "gaussian", "b")})),0.75) AS lim FROM fits a JOIN fits b ON a.epoch=b.epoch AND a.model='ridge_a' AND b.model='ridge_b' JOIN tr ON tr.epoch<a.epoch GROUP BY a.epoch),
sc AS (SELECT tr.*, lim, {predict_sql(ACTION, "gaussian", "a")} AS va, {predict_sql(ACTION, "gaussian", "b")} AS vb, {predict_sql(ACTION, "logistic", "c")} AS wa, {predict_sql(ACTION, "logistic", "d")} AS wb FROM tr JOIN lm ON lm.epoch=tr.epoch
 JOIN fits a ON a.epoch=tr.epoch AND a.model='ridge_a' JOIN fits b ON b.epoch=tr.epoch AND b.model='ridge_b' JOIN fits c ON c.epoch=tr.epoch AND c.model='win_a' JOIN fits d ON d.epoch=tr.epoch AND d.model='win_b'),
ac AS (SELECT *, (va+vb)/2 AS value, (wa+wb)/2 AS win, va+vb>0 AND (wa+wb)/2>=0.5 AND abs(va-vb)<=lim AS accepted FROM sc)
"""


@query("C26_action_fits", ACTIONS + "SELECT entity, period, round(value,6) AS value, round(win,6) AS win, accepted FROM ac")
def c26(spark, sf):
    return fitted_actions(spark, sf).select(*KEY, r6("value").alias("value"), r6("win").alias("win"), "accepted")


@query("C26_action_metrics", ACTIONS + """SELECT count(*) AS rows, round(avg(abs(value-gain)),6) AS mae, round(corr(value,gain),6) AS correlation, round(avg(gain) FILTER (accepted),6) AS accepted_gain, round(avg(gain) FILTER (NOT accepted),6) AS rejected_gain, round(avg(CASE WHEN accepted THEN 1e0 ELSE 0 END),6) AS accept_rate FROM ac""")
def c26b(spark, sf):
    out = m.action_metrics(fitted_actions(spark, sf), "gain")
    return out.select("rows", *[r6(c).alias(c) for c in ("mae", "correlation", "accepted_gain", "rejected_gain", "accept_rate")])


@query("C30_opportunity_value")
def c30(spark, sf):
    op = settle(opportunities(spark, sf).select("epoch", "period", "sig_a", "sig_b", F.col("deep").cast("double").alias("deep"), F.col("gain_a").cast("double").alias("gain_a")))
    out = m.opportunity_value(op, ["sig_a", "sig_b", "deep"], "gain_a", "sig_a", "value")
    return out.select("epoch", "period", r6("value").alias("value"), r6("scale").alias("scale"))
