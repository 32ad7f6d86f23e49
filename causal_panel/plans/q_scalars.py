"""Projections, filters and scalar functions over the panel (inventory group P)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards, markets, names, scalars, scoring
from ..operators.scale import exact_quantiles
from .bindings import FORECASTS, PANEL, forecasts, panel, table
from .registry import query, r6

KEY = ["entity", "period"]


@query("P1_clip", PANEL + """SELECT entity, period, CASE WHEN slate=0 THEN NULL ELSE greatest(least(points,8),1) END AS clipped FROM panel""")
def p1(spark, sf):
    x = F.when(F.col("slate") > 0, F.col("points"))
    return panel(spark, sf).select(*KEY, scalars.clip(x, 1, 8).alias("clipped"))


@query("P2_sigmoid", PANEL + """SELECT entity, period, round(1/(1+exp(-greatest(least(transfers/10e0,18e0),-18e0))),6) AS s FROM panel""")
def p2(spark, sf):
    return panel(spark, sf).select(*KEY, r6(scalars.sigmoid(F.col("transfers") / 10.0)).alias("s"))


@query("P3_signed_log", PANEL + """SELECT entity, period, round(sign(transfers)*ln(1+abs(transfers)),6) AS momentum FROM panel""")
def p3(spark, sf):
    return panel(spark, sf).select(*KEY, r6(scalars.signed_log("transfers")).alias("momentum"))


@query("P4_status_chance", """SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id%3=0 THEN json_extract_string(props,'$.k') WHEN event_id%3=1 THEN 'bad' END AS DOUBLE),
 CASE lower(coalesce(substr(CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'd' WHEN 'signup' THEN NULL ELSE event_type END,1,1),'a')) WHEN 'a' THEN 100e0 WHEN 'd' THEN 75e0 ELSE 0e0 END),0e0),100e0) AS chance FROM events""")
def p4(spark, sf):
    events = table(spark, sf, "events")
    chance = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k")).when(F.col("event_id") % 3 == 1, "bad")
    kind = F.col("event_type")
    status = F.when(kind == "view", "A").when(kind == "click", "d").when(kind == "signup", F.lit(None)).otherwise(kind)
    return events.select("event_id", scalars.status_chance(chance, F.substring(status, 1, 1)).alias("chance"))


@query("P5_first_match", PANEL + """SELECT entity, period, CASE WHEN points>=8 THEN 'haul' WHEN points>=5 THEN 'return' WHEN points<=2 THEN 'blank' ELSE 'plain' END AS outcome FROM panel""")
def p5(spark, sf):
    p = F.col("points")
    return panel(spark, sf).select(
        *KEY, scalars.first_match([(p >= 8, "haul"), (p >= 5, "return"), (p <= 2, "blank")], "plain").alias("outcome")
    )


@query("P5_roles_last_match", PANEL + """, x AS (SELECT *, goals/10e0 AS g, assists/10e0 AS a, clean*1e0 AS d, saves/8e0 AS s FROM panel)
SELECT entity, period, CASE position
 WHEN 1 THEN CASE WHEN s<3.2 THEN 'clean_sheet_keeper' ELSE 'shot_stopper' END
 WHEN 2 THEN CASE WHEN d>=7.8 AND g>=0.09 THEN 'set_piece_centre_back' WHEN a>=0.13 THEN 'attacking_full_back' WHEN d>=7.8 THEN 'centre_back' ELSE 'balanced_defender' END
 WHEN 3 THEN CASE WHEN g>=0.25 THEN 'goal_threat_midfielder' WHEN a>g*1.2e0 AND a>=0.16 THEN 'creator' WHEN d>=7.2 AND g+a<0.30 THEN 'holding_midfielder' ELSE 'box_to_box_midfielder' END
 WHEN 4 THEN CASE WHEN g>=0.34 THEN 'penalty_box_forward' WHEN a>=0.16 THEN 'link_forward' ELSE 'mobile_forward' END
 ELSE 'balanced' END AS role FROM x""")
def p5b(spark, sf):
    r = scoring.role("position", F.col("goals") / 10.0, F.col("assists") / 10.0, F.col("clean") * 1.0, F.col("saves") / 8.0)
    return panel(spark, sf).select(*KEY, r.alias("role"))


@query("P6_age_years", """SELECT o_orderkey, round(date_diff('day', TRY_CAST(CASE WHEN o_orderkey%7=0 THEN 'unknown' ELSE strftime(o_orderdate,'%Y-%m-%d') END AS DATE), DATE '2002-08-01')/365.2425e0,6) AS age FROM orders""")
def p6(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "orders").select(
        "o_orderkey", r6(scalars.age_years(text, F.lit("2002-08-01").cast("date"))).alias("age")
    )


@query("P7_gaussian_kernel", PANEL + """SELECT entity, period, round(exp(-pow((coalesce(CASE WHEN slate>0 THEN minutes END,27.5e0)-27.5e0)/7.5e0,2)),6) AS score FROM panel""")
def p7(spark, sf):
    x = F.when(F.col("slate") > 0, F.col("minutes"))
    return panel(spark, sf).select(*KEY, r6(scalars.gaussian_kernel(x, 27.5, 7.5)).alias("score"))


@query("P8_poisson_tail", PANEL + """SELECT entity, period, round(greatest(0,1-exp(-lines)*list_sum(list_transform(range(0,10), lambda i: pow(lines::DOUBLE,i)/factorial(i::INTEGER)))),6) AS p10,
 round(greatest(0,1-exp(-lines)*list_sum(list_transform(range(0,greatest(1,slate)), lambda i: pow(lines::DOUBLE,i)/factorial(i::INTEGER)))),6) AS p_slate FROM panel""")
def p8(spark, sf):
    return panel(spark, sf).select(
        *KEY,
        r6(scalars.poisson_tail("lines", 10)).alias("p10"),
        r6(scalars.poisson_tail("lines", F.col("slate"))).alias("p_slate"),
    )


ERF = "(0.5e0*(1+sign({x})*(1-(1/(1+0.3275911e0*abs({x})))*(0.254829592e0+(1/(1+0.3275911e0*abs({x})))*(-0.284496736e0+(1/(1+0.3275911e0*abs({x})))*(1.421413741e0+(1/(1+0.3275911e0*abs({x})))*(-1.453152027e0+(1/(1+0.3275911e0*abs({x})))*1.061405429e0))))*exp(-({x})*({x})))))"


def cdf_sql(z: str) -> str:
    return ERF.replace("{x}", f"(({z})/sqrt(2e0))")


@query("P9_normal_cdf", FORECASTS + f"""SELECT entity, period, round({cdf_sql('(2.5e0-f_base)/unc')},6) AS blank, round(1-{cdf_sql('(4.5e0-f_base)/unc')},6) AS ret, round(1-{cdf_sql('(7.5e0-f_base)/unc')},6) AS haul FROM fp""")
def p9(spark, sf):
    def z(cut):
        return (cut - F.col("f_base")) / F.col("unc")

    return forecasts(spark, sf).select(
        *KEY, r6(scalars.normal_cdf(z(2.5))).alias("blank"),
        r6(1 - scalars.normal_cdf(z(4.5))).alias("ret"), r6(1 - scalars.normal_cdf(z(7.5))).alias("haul"),
    )


FLOOR_MOMENT = "list_sum(list_transform(range(1,51), lambda i: exp(i*ln({l})-{l}-lgamma(i+1))*(i//{d}){sq}))"


@query("P10_floor_poisson_moments", PANEL + ", x AS (SELECT entity, period, greatest(0,least(30,lines/1e0)) AS l FROM panel) SELECT entity, period, round(m,6) AS mean, round(greatest(0,s-m*m),6) AS variance FROM (SELECT entity, period, "
       + FLOOR_MOMENT.format(l="l", d=3, sq="") + " AS m, " + FLOOR_MOMENT.format(l="l", d=3, sq="*(i//3)") + " AS s FROM x)")
def p10(spark, sf):
    mean, variance = scalars.floor_poisson_moments("lines", 3)
    return panel(spark, sf).select(*KEY, r6(mean).alias("mean"), r6(variance).alias("variance"))


@query("P11_no_vig", PANEL + """, x AS (SELECT entity, period, 1/greatest(1+goals/2e0,1.001e0) AS a, 1/greatest(1+assists/2e0,1.001e0) AS b, 1/greatest(1+clean/4e0,1.001e0) AS c FROM panel)
SELECT entity, period, round(a/(a+b+c),6) AS home, round(b/(a+b+c),6) AS draw, round(c/(a+b+c),6) AS away FROM x""")
def p11(spark, sf):
    home, draw, away = markets.no_vig([1 + F.col("goals") / 2.0, 1 + F.col("assists") / 2.0, 1 + F.col("clean") / 4.0])
    return panel(spark, sf).select(*KEY, r6(home).alias("home"), r6(draw).alias("draw"), r6(away).alias("away"))


@query("P12_implied_total", "WITH RECURSIVE " + PANEL[5:] + """, x AS (SELECT DISTINCT (conceded+1)/(lines+2e0) AS p FROM panel),
step(p, lo, hi, n) AS (SELECT p, 0.2e0, 6.5e0, 0 FROM x UNION ALL
 SELECT p, CASE WHEN 1-exp(-(lo+hi)/2)*(1+(lo+hi)/2+0.5e0*(lo+hi)/2*(lo+hi)/2) < p THEN (lo+hi)/2 ELSE lo END,
  CASE WHEN 1-exp(-(lo+hi)/2)*(1+(lo+hi)/2+0.5e0*(lo+hi)/2*(lo+hi)/2) < p THEN hi ELSE (lo+hi)/2 END, n+1 FROM step WHERE n<40)
SELECT entity, period, round((lo+hi)/2,6) AS rate FROM panel JOIN step ON step.p=(conceded+1)/(lines+2e0) AND n=40""")
def p12(spark, sf):
    return panel(spark, sf).select(
        *KEY, r6(markets.implied_total((F.col("conceded") + 1) / (F.col("lines") + 2.0))).alias("rate")
    )


@query("P13_order_book", PANEL + """, x AS (SELECT *, greatest(CASE WHEN goals>0 THEN 1+goals/2e0 END, CASE WHEN clean>0 THEN 1+clean/4e0 END) AS b,
 least(CASE WHEN assists>0 THEN 1+assists/2e0 END, CASE WHEN bonus>0 THEN 1+bonus/3e0 END) AS l FROM panel),
y AS (SELECT *, greatest(CASE WHEN goals>0 AND 1+goals/2e0=b THEN selected*1e0 END, CASE WHEN clean>0 AND 1+clean/4e0=b THEN saves*1e0 END) AS ba,
 least(CASE WHEN assists>0 AND 1+assists/2e0=l THEN minutes*1e0 END, CASE WHEN bonus>0 AND 1+bonus/3e0=l THEN lines*1e0 END) AS la FROM x)
SELECT entity, period, round(CASE WHEN b IS NOT NULL AND l IS NOT NULL THEN (1/b+1/l)/2 ELSE coalesce(1/b,1/l) END,6) AS probability, coalesce(ba,0)+coalesce(la,0) AS liquidity,
 round((l-b)/sqrt(l*b),6) AS spread FROM y""")
def p13(spark, sf):
    def offer(side, odds, amount):
        return F.struct(F.lit(side).alias("side"), odds.alias("odds"), F.col(amount).cast("double").alias("amount"))

    book = F.array(
        offer("back", 1 + F.col("goals") / 2.0, "selected"), offer("back", 1 + F.col("clean") / 4.0, "saves"),
        offer("lay", 1 + F.col("assists") / 2.0, "minutes"), offer("lay", 1 + F.col("bonus") / 3.0, "lines"),
    )
    with_book = panel(spark, sf).select(*KEY, book.alias("prices"))
    probability, liquidity, spread = markets.order_book(F.col("prices"))
    return with_book.select(*KEY, r6(probability).alias("probability"), liquidity.alias("liquidity"), r6(spread).alias("spread"))


@query("P14_market_quality", PANEL + """, x AS (SELECT entity, period, greatest(0.2e0,least(1e0,0.65e0*least(1,ln(1+selected)/ln(25001e0))+0.35e0*least(1,greatest(0.15e0,1-coalesce(greatest(CASE WHEN goals>0 THEN goals/50e0 END, CASE WHEN assists>0 THEN assists/40e0 END),0.25e0)/0.18e0)))) AS q FROM panel)
SELECT entity, period, round(q,6) AS quality FROM x""")
def p14(spark, sf):
    spreads = [F.when(F.col("goals") > 0, F.col("goals") / 50.0), F.when(F.col("assists") > 0, F.col("assists") / 40.0)]
    return panel(spark, sf).select(*KEY, r6(markets.market_quality("selected", spreads)).alias("quality"))


MIX = """, m0 AS (SELECT *, least(1e0,lines/9e0) AS play0, least(1e0,minutes/80e0) AS start0, least(1e0,saves/30e0) AS sixty0 FROM fp),
m1 AS (SELECT *, least(start0,play0) AS st, least(sixty0,least(start0,play0)) AS sx FROM m0),
m2 AS (SELECT *, 1-play0 AS no_show, play0-st AS cameo, st-sx AS start_under, sx AS sixty_plus FROM m1),
mix AS (SELECT *, greatest(0,least(1,-(no_show*ln(greatest(no_show,1e-12))+cameo*ln(greatest(cameo,1e-12))+start_under*ln(greatest(start_under,1e-12))+sixty_plus*ln(greatest(sixty_plus,1e-12)))/ln(4e0))) AS entropy FROM m2)
"""


def mixture():
    return scoring.minutes_mixture(F.col("lines") / 9.0, F.col("minutes") / 80.0, F.col("saves") / 30.0)


@query("P15_minutes_mixture", FORECASTS + MIX + """SELECT entity, period, round(no_show,6) AS no_show, round(cameo,6) AS cameo, round(start_under,6) AS start_under, round(sixty_plus,6) AS sixty_plus, round(entropy,6) AS entropy FROM mix""")
def p15(spark, sf):
    return panel(spark, sf).select(*KEY, *[r6(c).alias(name) for name, c in mixture().items()])


@query("P16_blends", FORECASTS + """SELECT entity, period, round(exp(0.7e0*ln(least(6,greatest(0.05e0,f_base)))+0.3e0*ln(least(6,greatest(0.05e0,f_price)))),6) AS rate,
 round(least(0.9e0,greatest(0.01e0,1/(1+exp(-(0.7e0*ln(least(0.99e0,greatest(0.01e0,prob))/(1-least(0.99e0,greatest(0.01e0,prob))))+0.3e0*ln(least(0.99e0,greatest(0.01e0,f_price/10))/(1-least(0.99e0,greatest(0.01e0,f_price/10))))))))),6) AS p FROM fp""")
def p16(spark, sf):
    return forecasts(spark, sf).select(
        *KEY, r6(markets.geometric_blend("f_base", "f_price", 0.3)).alias("rate"),
        r6(markets.probability_blend("prob", F.col("f_price") / 10, 0.3)).alias("p"),
    )


@query("P17_knots", FORECASTS + """, x AS (SELECT entity, period, lines*1e0 AS t, f_base AS a, f_base*3 AS b, f_base*5 AS c, f_base*7 AS d FROM fp)
SELECT entity, period, round(CASE WHEN t<1 THEN a WHEN t<3 THEN a+(b-a)*(t-1)/2 WHEN t<6 THEN b+(c-b)*(t-3)/3 WHEN t<10 THEN c+(d-c)*(t-6)/4 ELSE d END,6) AS value,
 round(CASE WHEN t<3 THEN (t-1)/2 WHEN t<6 THEN 1-(t-3)/3 ELSE 0 END * CASE WHEN t<1 THEN 0 ELSE 1 END + 0e0,6) AS w3,
 round(CASE WHEN t>=10 THEN 1 WHEN t>=6 THEN (t-6)/4 ELSE 0e0 END,6) AS w10 FROM x""")
def p17(spark, sf):
    f = F.col("f_base")
    held = F.col("lines").cast("double")
    weights = scalars.knot_weights(held, scoring.KNOTS)
    return forecasts(spark, sf).select(
        *KEY, r6(scalars.interpolate_knots(held, scoring.KNOTS, [f, f * 3, f * 5, f * 7])).alias("value"),
        r6(weights[1]).alias("w3"), r6(weights[3]).alias("w10"),
    )


@query("P18_durability_tenure", FORECASTS + """, x AS (SELECT *, greatest(0.12e0,least(0.96e0,0.78e0*(0.38e0*(lines/20e0)+0.24e0*(slate/20e0)+0.18e0*prob+0.2e0*(1-conceded/20e0))+0.22e0*(0.4e0*least(1,(n_prior/90e0)/0.64e0)+0.3e0*(1-exp(-n_prior/16e0))+0.3e0*prob)-0.12e0*(bonus/20e0))) AS s FROM fp),
y AS (SELECT *, least(10,greatest(2,2+8*s)) AS t FROM x)
SELECT entity, period, round(s,6) AS durability, round(t,6) AS tenure, round(1.5e0*greatest(0,least(1,(6-t)/4))*CASE WHEN 83-period>t THEN 1 ELSE 0 END,6) AS exit_cost FROM y""")
def p18(spark, sf):
    s = scoring.durability({
        "observations": F.col("n_prior"), "minutes_confidence": F.col("n_prior") / 90.0, "play": F.col("lines") / 20.0,
        "start": F.col("slate") / 20.0, "sixty": F.col("prob"), "volatility": F.col("conceded") / 20.0,
        "side_confidence": F.col("prob"), "shift": F.col("bonus") / 20.0,
    })
    d = forecasts(spark, sf).withColumn("s", s).withColumn("t", scoring.tenure("s"))
    return d.select(*KEY, r6("s").alias("durability"), r6("t").alias("tenure"),
                    r6(scoring.exit_cost("t", 83 - F.col("period"), 1.5)).alias("exit_cost"))


@query("P19_regime_probability", FORECASTS + """SELECT entity, period, round(1/(1+exp(-(-1.65e0+(n_prior/(n_prior+8e0))*(0.9e0*greatest(-2.5e0,least(2.5e0,(f_base-f_exp)/greatest(abs(f_exp),0.35e0)))+0.65e0*greatest(-2e0,least(2e0,(minutes-80)/30e0)))+0.85e0*greatest(0,least(1,conceded/5e0))+CASE WHEN is_home THEN 0.9e0 ELSE 0 END))),6) AS p FROM fp""")
def p19(spark, sf):
    p = scoring.regime_probability("f_base", "f_exp", "minutes", F.lit(80), F.col("conceded") / 5.0, "is_home", "n_prior")
    return forecasts(spark, sf).select(*KEY, r6(p).alias("p"))


@query("P20_fallback_chain", """, x AS (""".replace(", x AS (", "WITH x AS (") + """SELECT event_id, TRY_CAST(coalesce(CASE WHEN event_type='purchase' THEN CAST(value AS VARCHAR) END, CASE WHEN event_type<>'error' THEN json_extract_string(props,'$.k') END) AS DOUBLE) AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL THEN 0.5e0 ELSE round(least(1,greatest(0,CASE WHEN v>1 THEN v/100 ELSE v END)),6) END AS play FROM x""")
def p20(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("play"),
        F.when(F.col("event_type") != "error", F.from_json("props", "k double")).alias("model"),
    )
    value = scalars.col(scoring.first_path("play", "model.k"))
    return events.select("event_id", r6(scoring.fraction(value, 0.5)).alias("play"))


@query("P21_hard_unavailable", PANEL + """SELECT entity, period, slate=0 OR (CASE lines%4 WHEN 0 THEN 'i' WHEN 1 THEN 'a' WHEN 2 THEN 's' ELSE 'a' END IN ('i','s','u') AND coalesce(CASE WHEN goals>0 THEN goals-1 END <= 0, false)) AS out FROM panel""")
def p21(spark, sf):
    status = scalars.lookup(F.col("lines") % 4, {0: "I", 1: "a", 2: "s"})
    chance = F.when(F.col("goals") > 0, F.col("goals") - 1)
    return panel(spark, sf).select(*KEY, scoring.hard_unavailable("slate", status, chance).alias("out"))


@query("P22_resale", PANEL + """, x AS (SELECT entity, period, price, coalesce(lag(price) OVER (PARTITION BY entity ORDER BY period), price) AS bought FROM panel)
SELECT entity, period, CAST(CASE WHEN price<=bought THEN price ELSE bought+(price-bought)//2 END AS INTEGER) AS sale FROM x""")
def p22(spark, sf):
    from pyspark.sql import Window
    bought = F.coalesce(F.lag("price").over(Window.partitionBy("entity").orderBy("period")), F.col("price"))
    return panel(spark, sf).withColumn("bought", bought).select(*KEY, scoring.resale("price", "bought").alias("sale"))


GOAL_SQL = "CASE position WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 4 END"
CLEAN_SQL = "CASE position WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END"
ROUTES = {"position": "position", "appearances": "slate", "sixties": "slate", "goals": "goals", "assists": "assists",
          "clean": "clean", "saves": "saves", "conceded": "conceded", "bonus": "bonus", "points": "points"}


@query("P23_points_routes", PANEL + f""", x AS (SELECT *, 2*slate AS appearance, goals*{GOAL_SQL}+3*assists AS attack, clean*{CLEAN_SQL}+CASE WHEN position=1 THEN saves//3 ELSE 0 END-CASE WHEN position<=2 THEN conceded//2 ELSE 0 END AS defence FROM panel)
SELECT entity, period, CAST(appearance AS DOUBLE) AS appearance, CAST(attack AS DOUBLE) AS attack, CAST(defence AS DOUBLE) AS defence, CAST(bonus AS DOUBLE) AS bonus, CAST(points-appearance-attack-defence-bonus AS DOUBLE) AS other FROM x""")
def p23(spark, sf):
    routes = scoring.points_routes(ROUTES)
    return panel(spark, sf).select(*KEY, *[c.cast("double").alias(n) for n, c in routes.items()])


def with_routes(spark, sf):
    """Forecast panel with group medians and the routes of the forecast."""
    fp = forecasts(spark, sf).withColumn("gv", F.col("conceded") + 0.5).withColumn("av", F.col("bonus") + 0.5)
    groups = ["epoch", "period", "position"]
    medians = exact_quantiles(fp, groups, {"goal_median": ("gv", 0.5), "assist_median": ("av", 0.5)})
    fp = fp.join(medians, groups)
    routes = scoring.forecast_routes({
        "position": "position", "slate": "slate", "minutes": F.col("minutes"), "slate_rank": F.lit(None).cast("double"),
        "goal_vulnerability": "gv", "goal_median": "goal_median", "assist_vulnerability": "av", "assist_median": "assist_median",
        "play": F.col("lines") / 20.0, "sixty": F.col("lines") / 25.0, "goal_rate": F.col("goals") / 20.0,
        "assist_rate": F.col("assists") / 20.0, "side_clean": "prob", "clean_rate": F.col("clean") / 20.0,
        "bonus_rate": F.col("bonus") / 10.0, "forecast": "f_base",
    })
    for name, c in routes.items():
        fp = fp.withColumn(f"r_{name}", c)
    return fp


ROUTED = FORECASTS + f""", g AS (SELECT epoch, period, position, quantile_cont(conceded+0.5e0,0.5) AS gm, quantile_cont(bonus+0.5e0,0.5) AS am FROM fp GROUP BY ALL),
w AS (SELECT fp.*, greatest(slate,1) AS fx, minutes/90e0 AS ex, least(1.42e0,greatest(0.68e0,(conceded+0.5e0)/greatest(gm,0.01e0))) AS gs, least(1.35e0,greatest(0.72e0,(bonus+0.5e0)/greatest(am,0.01e0))) AS asd FROM fp JOIN g USING (epoch, period, position)),
routed AS (SELECT *, (lines/20e0+lines/25e0)*fx AS r_appearance, (goals/20e0*{GOAL_SQL}*gs+3*(assists/20e0)*asd)*ex*1.0e0*fx AS r_attack,
 least(0.78e0,greatest(0.03e0,0.82e0*prob+0.18e0*(clean/20e0)))*{CLEAN_SQL}*(lines/25e0)*fx AS r_clean, bonus/10e0*ex*1.0e0*fx AS r_bonus FROM w)
"""


@query("P24_forecast_routes", ROUTED + """SELECT entity, period, round(r_appearance,6) AS appearance, round(r_attack,6) AS attack, round(r_clean,6) AS clean, round(r_bonus,6) AS bonus, round(f_base-(r_appearance+r_attack+r_clean+r_bonus),6) AS residual FROM routed""")
def p24(spark, sf):
    return with_routes(spark, sf).select(
        *KEY, *[r6(f"r_{n}").alias(n) for n in ("appearance", "attack", "clean", "bonus", "residual")]
    )


def _fm(l, d, sq=False):
    return FLOOR_MOMENT.format(l=l, d=d, sq=f"*(i//{d})" if sq else "")


@query("P25_route_distribution", PANEL + f""", x AS (SELECT *, (saves+1)/10e0 AS s, (conceded+1)/3e0 AS c FROM panel),
y AS (SELECT *, {_fm('s', 3)} AS sm, {_fm('s', 3, True)} AS s2, {_fm('c', 2)} AS cm, {_fm('c', 2, True)} AS c2, {GOAL_SQL} AS gp, {CLEAN_SQL} AS cp,
 CASE WHEN position=1 THEN 1 ELSE 0 END AS k, CASE WHEN position<=2 THEN 1 ELSE 0 END AS b FROM x)
SELECT entity, period, round(0.9e0+0.7e0+gp*(goals/20e0)+3*(assists/20e0)+cp*(clean/20e0)+k*sm-b*cm+bonus/10e0+0.2e0+0.1e0,6) AS mean,
 round(greatest(0.16e0,0.9e0+0.7e0+gp*gp*(goals/20e0)+9*(assists/20e0)+cp*cp*(clean/20e0)+k*(s2-sm*sm)+b*(c2-cm*cm)+bonus/10e0+0.2e0+0.3e0),6) AS variance FROM y""")
def p25(spark, sf):
    mean, variance = scoring.route_distribution({
        "position": "position", "appearance": F.lit(0.9), "sixty": F.lit(0.7), "goals": F.col("goals") / 20.0,
        "assists": F.col("assists") / 20.0, "clean": F.col("clean") / 20.0, "saves": (F.col("saves") + 1) / 10.0,
        "conceded": (F.col("conceded") + 1) / 3.0, "bonus": F.col("bonus") / 10.0, "actions": F.lit(0.2),
        "other": F.lit(0.1), "other_variance": F.lit(0.3),
    })
    return panel(spark, sf).select(*KEY, r6(mean).alias("mean"), r6(variance).alias("variance"))


@query("P26_limited_adjustment", ROUTED + f"""SELECT entity, period, round(CASE WHEN slate=0 THEN 0 ELSE f_base+CASE WHEN slate=1 THEN r_attack*(least(1.55e0,greatest(0.6e0,f_price/greatest(f_base,0.25e0)))-1)+0.82e0*(prob-f_price/10)*{CLEAN_SQL}*(lines/25e0)*fx-0.5e0*(conceded/3e0-bonus/3e0)*(minutes/90e0)*CASE WHEN position<=2 THEN 1 ELSE 0 END ELSE 0 END END,6) AS score FROM routed""")
def p26(spark, sf):
    score = scoring.limited_adjustment({
        "slate": "slate", "position": "position", "new_for": "f_price", "old_for": "f_base", "attack": "r_attack",
        "new_clean": "prob", "old_clean": F.col("f_price") / 10, "sixty": F.col("lines") / 25.0,
        "new_against": F.col("conceded") / 3.0, "old_against": F.col("bonus") / 3.0, "minutes": "minutes",
        "covered": F.col("slate") == 1, "score": "f_base",
    })
    return with_routes(spark, sf).select(*KEY, r6(score).alias("score"))


@query("P27_reliability_penalty", FORECASTS + MIX + """SELECT entity, period, round(CASE WHEN slate=0 THEN 0 ELSE f_base*greatest(0.55e0,least(1,1+0.8e0*least(0.45e0*(1-no_show)+0.55e0*sixty_plus-(0.45e0*prob+0.55e0*least(1,f_price/8)),0)*(0.75e0+0.25e0*entropy))) END,6) AS score FROM mix""")
def p27(spark, sf):
    score = scoring.reliability_penalty("f_base", "slate", mixture(), "prob", F.col("f_price") / 8, 0.8)
    return forecasts(spark, sf).select(*KEY, r6(score).alias("score"))


@query("P28_availability_overlay", FORECASTS + """, x AS (SELECT *, greatest(0,least(1.25e0,least(100,lines*12)/greatest(coalesce(CASE WHEN goals>0 THEN goals*20e0 END,100e0),1))) AS ratio FROM fp),
y AS (SELECT *, floor(greatest(minutes*1e0,1)*ratio+0.5e0) AS after FROM x)
SELECT entity, period, round(ratio,6) AS ratio, floor(least(98,prob*100*ratio)+0.5e0) AS probability, after AS minutes, round(f_base*greatest(0,least(1.25e0,after/greatest(minutes*1e0,1))),6) AS projected FROM y""")
def p28(spark, sf):
    out = scoring.availability_overlay(
        F.least(F.lit(100), F.col("lines") * 12), F.when(F.col("goals") > 0, F.col("goals") * 20.0),
        F.col("prob") * 100, "minutes", "f_base",
    )
    return forecasts(spark, sf).select(
        *KEY, r6(out["ratio"]).alias("ratio"), out["probability"].cast("double").alias("probability"),
        out["minutes"].cast("double").alias("minutes"), r6(out["projected"]).alias("projected"),
    )


@query("P29_counterfactual", ROUTED + f""", x AS (SELECT *, f_base-(r_appearance+r_attack+r_clean+r_bonus) AS rs, least(80,lines*10e0)*fx AS em FROM routed),
y AS (SELECT *, least(2.25e0,greatest(0,CASE WHEN em>0 THEN minutes/greatest(em,8) ELSE 0 END)) AS mr, least(2.75e0,greatest(0,CASE WHEN f_price*fx>0 THEN points/greatest(f_price*fx,0.25e0) ELSE 0 END)) AS tr FROM x)
SELECT entity, period,
 round(greatest(-2,least(35,CASE WHEN slate=0 THEN 0 ELSE 2*slate+r_attack*mr+least(0.78e0,greatest(0.03e0,0.82e0*prob+0.18e0*(clean/20e0)))*{CLEAN_SQL}*slate+r_bonus*mr+rs END)),6) AS known_minutes,
 round(greatest(-2,least(35,CASE WHEN slate=0 THEN 0 ELSE r_appearance+r_attack*tr+{CLEAN_SQL}*((lines/25e0)*fx)*(clean/greatest(lines,1)::DOUBLE)+r_bonus+rs END)),6) AS known_outcome,
 round(greatest(-2,least(35,CASE WHEN slate=0 THEN 0 ELSE r_appearance+goals*{GOAL_SQL}+3e0*assists+r_clean+r_bonus+rs END)),6) AS known_events,
 CAST(points AS DOUBLE) AS known_total FROM y""")
def p29(spark, sf):
    c = {**ROUTES, "appearance": "r_appearance", "attack": "r_attack", "clean_route": "r_clean", "bonus_route": "r_bonus",
         "residual": "r_residual", "slate": "slate", "expected_minutes": F.least(F.lit(80.0), F.col("lines") * 10.0),
         "minutes": "minutes", "side_clean": "prob", "clean_rate": F.col("clean") / 20.0, "side_for": "f_price",
         "side_goals": "points", "side_cleans": "clean", "side_games": "lines", "sixty": F.col("lines") / 25.0}
    return with_routes(spark, sf).select(
        *KEY,
        r6(scoring.counterfactual_score(c, minutes=True)).alias("known_minutes"),
        r6(scoring.counterfactual_score(c, outcome=True)).alias("known_outcome"),
        r6(scoring.counterfactual_score(c, involvement=True)).alias("known_events"),
        scoring.counterfactual_score(c, total=True).alias("known_total"),
    )


@query("P30_name_key", """SELECT doc_id, md5(regexp_replace(translate(lower(text),'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšşťūůűźżž','aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz'),'[^a-z0-9]','','g')) AS text_key, CASE source WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'second' ELSE source END AS origin FROM documents""")
def p30(spark, sf):
    docs = table(spark, sf, "documents")
    aliases = spark.createDataFrame([("src1", "first"), ("src2", "second")], "alias string, canonical string")
    keyed = docs.select("doc_id", F.md5(names.name_key("text").cast("binary")).alias("text_key"), names.team_key("source").alias("source"))
    return names.resolve_alias(keyed, "source", F.broadcast(aliases), "origin").select("doc_id", "text_key", "origin")


@query("P31_leakage_guard", FORECASTS + "SELECT entity, period, round(f_base,6) AS f_base, round(f_exp,6) AS f_exp FROM fp")
def p31(spark, sf):
    safe = guards.guarded(forecasts(spark, sf), KEY, ["f_base", "f_exp"])
    return safe.select(*KEY, r6("f_base").alias("f_base"), r6("f_exp").alias("f_exp"))


@query("P32_affine_score", FORECASTS + """, m AS (SELECT position, avg(minutes) AS c1, avg(lines) AS c2, max(minutes)-min(minutes) AS s1, max(lines)-min(lines) AS s2 FROM fp WHERE position<4 GROUP BY 1)
SELECT entity, period, round(2.5e0+0.8e0*(minutes-c1)/CASE WHEN s1>0 THEN s1 ELSE 1 END+1.2e0*(lines-c2)/CASE WHEN s2>0 THEN s2 ELSE 1 END,6) AS score FROM fp LEFT JOIN m USING (position)""")
def p32(spark, sf):
    p = panel(spark, sf)
    spread = [(F.max(c) - F.min(c)).cast("double") for c in ("minutes", "lines")]
    fitted = p.where(F.col("position") < 4).groupBy("position").agg(
        F.struct(
            F.array(F.avg("minutes"), F.avg("lines")).alias("centre"), F.array(*spread).alias("scale"),
            F.array(F.lit(0.8), F.lit(1.2)).alias("coef"), F.lit(2.5).alias("intercept"),
        ).alias("model")
    )
    # one model row per position: four at most
    joined = p.join(F.broadcast(fitted), "position", "left")
    return joined.select(*KEY, r6(scalars.affine_score(["minutes", "lines"], F.col("model"))).alias("score"))


@query("P33_exposure_mixture", FORECASTS + """, x AS (SELECT *, least(90e0,greatest(3e0,prob*80+(1-prob)*(lines/20e0)*f_price)) AS m, prob*(80e0*80e0+144)+(1-prob)*(lines/20e0)*(f_price*f_price+100) AS s2 FROM fp)
SELECT entity, period, round(m,6) AS mean, round(least(42,greatest(4,sqrt(greatest(16,s2-m*m)))),6) AS std FROM x""")
def p33(spark, sf):
    mean, std = scoring.exposure_mixture("prob", F.col("lines") / 20.0, F.lit(80.0), "f_price")
    return forecasts(spark, sf).select(*KEY, r6(mean).alias("mean"), r6(std).alias("std"))


@query("P34_slate_value", FORECASTS + """SELECT entity, period, round(CASE WHEN position<=2 THEN 0.34e0*(f_base/1.4e0)+0.66e0*(prob/0.25e0) WHEN position=3 THEN 0.84e0*(f_base/1.4e0)+0.16e0*(prob/0.25e0) ELSE f_base/1.4e0 END,6) AS value FROM fp""")
def p34(spark, sf):
    return forecasts(spark, sf).select(
        *KEY, r6(scoring.slate_value("position", F.col("f_base") / 1.4, F.col("prob") / 0.25)).alias("value")
    )


@query("P35_uncertainty", FORECASTS + """, x AS (SELECT *, least(5.5e0,greatest(1.2e0,sqrt(1.1e0*1.1e0+0.02e0*f_price*f_price+0.85e0*pow(abs(f_base-f_exp)/2,2)+2.2e0/sqrt(n_prior+1e0)))) AS u FROM fp),
y AS (SELECT *, least(1e0,greatest(0.05e0,u/greatest(f_base+u,1)+0.08e0*(bonus/20e0)+0.1e0*greatest(0,least(1,1-lines*5/100e0)))) AS ru FROM x)
SELECT entity, period, round(u,6) AS uncertainty, round(ru,6) AS relative, round(least(95,greatest(0,100*(1-ru))),6) AS confidence FROM y""")
def p35(spark, sf):
    d = forecasts(spark, sf).withColumn(
        "u", scoring.prediction_uncertainty("f_price", scalars.population_std(["f_base", "f_exp"]), "n_prior")
    ).withColumn("ru", scoring.relative_uncertainty("u", "f_base", F.col("bonus") / 20.0, F.col("lines") * 5))
    return d.select(*KEY, r6("u").alias("uncertainty"), r6("ru").alias("relative"), r6(scoring.confidence("ru")).alias("confidence"))


@query("P36_labels_verdict", PANEL + """, x AS (SELECT *, concat_ws('|', CASE WHEN minutes<60 THEN 'Minutes risk' END, CASE WHEN slate=0 THEN 'Fitness flag' END, CASE WHEN lines<4 THEN 'Small sample' END, CASE WHEN conceded>=5 THEN 'Wide projection' END) AS f FROM panel)
SELECT entity, period, CASE WHEN f='' THEN 'No major flag' ELSE f END AS flags, CASE WHEN lines/15e0>=0.9 AND minutes>=65 THEN 'Priority' WHEN lines/15e0>=0.75 AND minutes>=55 THEN 'Strong' WHEN lines/15e0>=0.45 THEN 'Watch' ELSE 'Fade' END AS verdict FROM x""")
def p36(spark, sf):
    flags = scoring.labels([
        (F.col("minutes") < 60, "Minutes risk"), (F.col("slate") == 0, "Fitness flag"),
        (F.col("lines") < 4, "Small sample"), (F.col("conceded") >= 5, "Wide projection"),
    ], "No major flag")
    return panel(spark, sf).select(
        *KEY, F.array_join(flags, "|").alias("flags"), scoring.verdict(F.col("lines") / 15.0, "minutes").alias("verdict")
    )


@query("P37_eligibility", PANEL + """SELECT entity, period FROM panel WHERE CASE lines%3 WHEN 0 THEN 'a' WHEN 1 THEN 'd' ELSE 'i' END IN ('a','d') AND minutes>=75 AND price>=35 AND (saves>=30 OR goals>=3 OR assists>=4)""")
def p37(spark, sf):
    status = scalars.lookup(F.col("lines") % 3, {0: "a", 1: "d"}, "i")
    test = scoring.eligible(status, "minutes", "price", F.col("saves") * 6, F.col("goals") / 6.0, F.col("assists") / 1.6)
    return panel(spark, sf).where(test).select(*KEY)
