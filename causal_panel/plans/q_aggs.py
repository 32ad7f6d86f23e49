"""Aggregations, metrics, resampling and policy comparisons (inventory group G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import population_std
from ..operators import aggs as g

from ..operators.joins import near_price_pairs

from .bindings import DAY, FORECASTS, PANEL, forecasts, panel, table
from .q_joins import PAIR_SQL
from .q_windows import pct_sql
from .registry import query, r6

KEY = ["entity", "period"]


def rounded(df, keys, columns):
    return df.select(*keys, *[r6(c).alias(c) for c in columns])


@query("G1_mixed_rollup", """SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, round(avg(l_linenumber),6) AS mean_line, max(l_discount) AS max_discount,
 arg_min(CASE WHEN l_returnflag<>'N' THEN l_returnflag END, l_orderkey*1000000+l_partkey) FILTER (l_returnflag<>'N') AS first_flag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL""")
def g1(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("yr"), F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_linenumber").alias("line"), F.col("l_discount").alias("discount"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_partkey").alias("parts"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("at"),
    )
    out = g.mixed_rollup(lines, ["entity", "yr"], F.col("at"), ["qty"], ["line"], ["discount"], ["flag"], ["parts"])
    return out.withColumn("mean_line", r6("mean_line"))


@query("G2_two_level_rollup", """WITH f AS (SELECT l_suppkey%25 AS side, CAST(year(l_shipdate) AS INTEGER) AS yr, l_orderkey, max(l_linenumber) AS most, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY ALL)
SELECT side, yr, count(*) AS games, CAST(sum(most) AS BIGINT) AS most, CAST(sum(qty) AS BIGINT) AS qty FROM f GROUP BY ALL""")
def g2(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("side"), F.year("l_shipdate").alias("yr"), "l_orderkey",
        F.col("l_linenumber").alias("most"), F.col("l_quantity").cast("bigint").alias("qty"),
    )
    return g.two_level_rollup(lines, ["side", "yr"], ["l_orderkey"], ["most"], ["qty"])


@query("G3_feed_quality", PANEL + """, q AS (SELECT period FROM panel WHERE selected>=2500 AND slate>0 GROUP BY period HAVING count(*)>=20 AND avg(CASE WHEN goals-1<=0 THEN 1e0 ELSE 0e0 END)<=0.3)
SELECT entity, p.period, q.period IS NOT NULL AS trusted FROM panel p LEFT JOIN q ON q.period=p.period""")
def g3(spark, sf):
    p = panel(spark, sf).withColumn("outlook", F.col("goals") - 1)
    return g.feed_quality(p, ["period"], (F.col("selected") >= 2500) & (F.col("slate") > 0), "outlook", 20, 0.3).select(*KEY, "trusted")


@query("G4_distribution_summary", PANEL + """SELECT entity, count(*) AS matches, CAST(sum(points) AS BIGINT) AS total, round(avg(points),6) AS average, round(stddev_samp(points),6) AS volatility, round(avg(CASE WHEN points>=5 THEN 1e0 ELSE 0e0 END),6) AS return_rate, round(90*sum(points)/greatest(sum(minutes),1)::DOUBLE,6) AS per90 FROM panel WHERE minutes>0 GROUP BY entity""")
def g4(spark, sf):
    out = g.distribution_summary(panel(spark, sf).where(F.col("minutes") > 0), ["entity"], "points", "minutes")
    return rounded(out, ["entity", "matches", "total"], ["average", "volatility", "return_rate", "per90"])


METRIC_SQL = "count(*) AS rows, round(avg(f),6) AS forecast, round(avg(points),6) AS actual, round(avg(f-points),6) AS bias, round(avg(abs(f-points)),6) AS mae, round(avg(CASE WHEN points>=5 THEN 1e0 ELSE 0e0 END),6) AS return_rate, round(avg(CASE WHEN points<=2 THEN 1e0 ELSE 0e0 END),6) AS blank_rate"


@query("G5_segment_metrics", FORECASTS + f""", x AS (SELECT *, f_base AS f FROM fp WHERE slate>0), t AS (SELECT 'overall' AS segment, 'all' AS value, f, points FROM x UNION ALL SELECT 'stratum', stratum, f, points FROM x
 UNION ALL SELECT 'phase', CASE WHEN period%12<=2 THEN 'early' WHEN period%12<=7 THEN 'middle' ELSE 'late' END, f, points FROM x UNION ALL SELECT 'price', CASE WHEN price>=75 THEN 'premium' ELSE 'other' END, f, points FROM x)
SELECT segment, value, {METRIC_SQL} FROM t GROUP BY ALL""")
def g5(spark, sf):
    fp = forecasts(spark, sf).where(F.col("slate") > 0)
    phase = g.cut(F.col("period") % 12, [-1, 2, 7, 11], ["early", "middle", "late"])
    tier = F.when(F.col("price") >= 75, "premium").otherwise("other")
    out = g.segment_metrics(fp, "f_base", "points", {"stratum": F.col("stratum"), "phase": phase, "price": tier})
    return rounded(out, ["segment", "value", "rows"], ["forecast", "actual", "bias", "mae", "return_rate", "blank_rate"])


@query("G6_fixed_bins", PANEL + """SELECT CASE WHEN minutes<=30 THEN 'low' WHEN minutes<=60 THEN 'middle' WHEN minutes<=90 THEN 'high' END AS tier, count(*) AS rows, CAST(sum(points) AS BIGINT) AS total FROM panel GROUP BY ALL""")
def g6(spark, sf):
    tier = g.cut("minutes", [-1, 30, 60, 90], ["low", "middle", "high"])
    return panel(spark, sf).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("rows"), F.sum("points").alias("total"))


def qcut_sql(x: str, parts: int, source: str, part: str = "") -> str:
    edges = ", ".join(f"quantile_cont({x},{i / parts})" for i in range(parts + 1))
    return f"(SELECT list_sort(list_distinct([{edges}])) AS edges{', ' + part if part else ''} FROM {source}{' GROUP BY ' + part if part else ''})"


@query("G7_quantile_bins", FORECASTS + f", e AS {qcut_sql('f_base', 5, 'fp')}" + ", b AS (SELECT fp.*, len(list_filter(edges[2:len(edges)-1], lambda v: v<f_base)) AS bin FROM fp, e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS rows, round(min(f_base),6) AS low, round(max(f_base),6) AS high FROM b GROUP BY bin")
def g7(spark, sf):
    binned = g.quantile_bins(forecasts(spark, sf), "f_base", 5, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), r6(F.min("f_base")).alias("low"), r6(F.max("f_base")).alias("high"))


@query("G8_poisson_deviance", FORECASTS + "SELECT epoch, round(avg(2*(CASE WHEN points>0 THEN points*ln(points/greatest(f_base,0.02e0)) ELSE 0 END-(points-greatest(f_base,0.02e0)))),6) AS deviance FROM fp GROUP BY epoch")
def g8(spark, sf):
    return forecasts(spark, sf).groupBy("epoch").agg(r6(g.poisson_deviance("points", "f_base")).alias("deviance"))


@query("G9_brier", FORECASTS + """, x AS (SELECT *, CASE WHEN points>=5 THEN 1e0 ELSE 0e0 END AS y, slate*1e0 AS wt FROM fp)
SELECT epoch, round(sum(wt*pow(prob-y,2))/sum(wt),6) AS brier, round(sum(wt*abs(prob-y))/sum(wt),6) AS mae, round(sum(wt*(prob-y))/sum(wt),6) AS bias FROM x WHERE wt>0 GROUP BY epoch""")
def g9(spark, sf):
    hit = F.when(F.col("points") >= 5, 1.0).otherwise(0.0)
    out = g.weighted_probability_metrics(forecasts(spark, sf), ["epoch"], "prob", hit, "slate")
    return rounded(out, ["epoch"], ["brier", "mae", "bias"])


@query("G10_reliability", FORECASTS + "SELECT CAST(least(floor(prob*10),9) AS INTEGER) AS bin, round(avg(prob),6) AS forecast, round(avg(CASE WHEN points>=5 THEN 1e0 ELSE 0e0 END),6) AS observed, count(*) AS rows FROM fp WHERE slate>0 GROUP BY 1")
def g10(spark, sf):
    hit = F.when(F.col("points") >= 5, 1.0).otherwise(0.0)
    out = g.reliability(forecasts(spark, sf).where(F.col("slate") > 0), "prob", hit)
    return rounded(out, ["bin", "rows"], ["forecast", "observed"])


@query("G11_interval_coverage", FORECASTS + "SELECT round(avg(CASE WHEN abs(points-f_base)<=0.8e0*unc THEN 1e0 ELSE 0e0 END),6) AS coverage, round(avg(CASE WHEN points-f_base>=-0.8e0*unc THEN 1e0 ELSE 0e0 END),6) AS lower_coverage, round(avg(CASE WHEN points-f_base<=0.8e0*unc THEN 1e0 ELSE 0e0 END),6) AS upper_coverage FROM fp")
def g11(spark, sf):
    out = g.interval_coverage(forecasts(spark, sf), F.col("points") - F.col("f_base"), -0.8 * F.col("unc"), 0.8 * F.col("unc"))
    return rounded(out, [], ["coverage", "lower_coverage", "upper_coverage"])


@query("G11_sigma_bins", FORECASTS + f", e AS {qcut_sql('unc', 5, 'fp')}" + ", b AS (SELECT fp.*, len(list_filter(edges[2:len(edges)-1], lambda v: v<unc)) AS bin FROM fp, e) SELECT CAST(bin AS INTEGER) AS bin, round(avg(unc),6) AS predicted, round(stddev_pop(points-f_base),6) AS realised, round(avg(abs(points-f_base)),6) AS mae, count(*) AS rows FROM b GROUP BY bin")
def g11b(spark, sf):
    fp = forecasts(spark, sf).withColumn("residual", F.col("points") - F.col("f_base"))
    return rounded(g.sigma_bins(fp, "unc", "residual"), ["bin", "rows"], ["predicted", "realised", "mae"])


@query("G12_group_spearman", FORECASTS + f""", r AS (SELECT period, {pct_sql('f_base', 'period')} AS a, {pct_sql('points', 'period')} AS b FROM fp), s AS (SELECT period, count(*) AS n, corr(a,b) AS c FROM r GROUP BY period)
SELECT period, n AS rows, round(c,6) AS spearman FROM s WHERE n>=20 AND c IS NOT NULL AND NOT isnan(c)""")
def g12(spark, sf):
    fp = forecasts(spark, sf).select("period", "f_base", "points")
    return rounded(g.group_spearman(fp, ["period"], "f_base", "points"), ["period", "rows"], ["spearman"])


@query("G13_weighted_correlation", FORECASTS + """, m AS (SELECT epoch, sum(slate*1e0) AS n, sum(slate*f_base) AS a, sum(slate*points*1e0) AS b, sum(slate*f_base*f_base) AS aa, sum(slate*points*points*1e0) AS bb, sum(slate*f_base*points) AS ab FROM fp GROUP BY epoch)
SELECT epoch, round((ab/n-a/n*(b/n))/sqrt((aa/n-pow(a/n,2))*(bb/n-pow(b/n,2))),6) AS correlation FROM m""")
def g13(spark, sf):
    fp = forecasts(spark, sf)
    return fp.groupBy("epoch").agg(r6(g.weighted_correlation("f_base", "points", F.col("slate").cast("double"))).alias("correlation"))


@query("G14_top_quality", FORECASTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f_base DESC, entity) AS k FROM fp WHERE slate>0)
SELECT period, count(*) AS rows, round(avg(CASE WHEN k<=15 THEN points END),6) AS top_points, round(avg(CASE WHEN k<=15 THEN CASE WHEN points<=2 THEN 1e0 ELSE 0e0 END END),6) AS top_blank_rate, round(CASE WHEN count(*) FILTER (points>=8)>0 THEN count(*) FILTER (points>=8 AND k>15)/count(*) FILTER (points>=8)::DOUBLE ELSE 0 END,6) AS missed_rate FROM r GROUP BY period""")
def g14(spark, sf):
    out = g.top_quality(forecasts(spark, sf).where(F.col("slate") > 0), ["period"], "f_base", "points", "entity")
    return rounded(out, ["period", "rows"], ["top_points", "top_blank_rate", "missed_rate"])


@query("G15_pair_accuracy", FORECASTS + PAIR_SQL + "SELECT position, count(*) AS pairs, round(avg(CASE WHEN good THEN 1e0 ELSE 0e0 END),6) AS accuracy FROM prs GROUP BY position")
def g15(spark, sf):
    counted = near_price_pairs(forecasts(spark, sf), ["period", "position"], "price", "f_base", "points", band=5)
    return counted.groupBy("position").agg(F.sum("pairs").alias("pairs"), r6(F.sum("ordered") / F.sum("pairs")).alias("accuracy"))


@query("G16_cap_regret", FORECASTS + """, sp AS (SELECT period, position, CAST(ceil(min(price)/10e0)*10 AS INTEGER) AS lo, CAST(floor(max(price)/10e0)*10 AS INTEGER) AS hi FROM fp GROUP BY ALL), cp AS (SELECT period, position, unnest(range(lo,hi+1,10)) AS cap FROM sp),
r AS (SELECT cp.period, cp.position, cp.cap, points, row_number() OVER (PARTITION BY cp.period, cp.position, cap ORDER BY f_base DESC, entity) AS a, row_number() OVER (PARTITION BY cp.period, cp.position, cap ORDER BY points DESC, entity) AS b FROM cp JOIN fp ON fp.period=cp.period AND fp.position=cp.position AND price<=cap)
SELECT period, position, CAST(cap AS INTEGER) AS cap, count(*) AS affordable, CAST(max(CASE WHEN b=1 THEN points END)-max(CASE WHEN a=1 THEN points END) AS DOUBLE) AS regret, CAST(sum(CASE WHEN b<=3 THEN points ELSE 0 END)-sum(CASE WHEN a<=3 THEN points ELSE 0 END) AS DOUBLE) AS regret3 FROM r GROUP BY ALL HAVING count(*)>=5""")
def g16(spark, sf):
    return g.cap_regret(forecasts(spark, sf), ["period", "position"], "entity", "price", "f_base", "points")


ANCHOR = """WITH t AS (SELECT o_custkey, CAST(floor(sum(CAST(floor(o_totalprice) AS BIGINT))/10000) AS BIGINT) AS points FROM orders GROUP BY 1), a AS (SELECT points, CAST(rank() OVER (ORDER BY points DESC) AS BIGINT) AS "rank" FROM t),
an AS (SELECT *, ln("rank"::DOUBLE) AS log_rank, row_number() OVER (ORDER BY abs(ln("rank"::DOUBLE)-ln(100e0)), points, "rank")-1 AS i FROM (SELECT DISTINCT points::DOUBLE AS points, "rank" FROM a)),
loc AS (SELECT * FROM an WHERE i<120)
"""


def anchors(spark, sf):
    from ..operators.scale import ordered_prefix
    totals = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("total"))
    scored = totals.select(F.expr("total div 10000").alias("points")).withColumn("_neg", -F.col("points"))
    ranked = ordered_prefix(scored, [], "_neg").select((-F.col("_neg")).alias("points"), (F.col("n_before") + 1).alias("rank"))
    return g.local_anchors(ranked, "points", "rank", 100)


@query("G17_rank_fit", ANCHOR + """, f AS (SELECT regr_slope(log_rank, points) AS slope, regr_intercept(log_rank, points) AS intercept, regr_r2(log_rank, points) AS r2, count(*) AS anchors, max(CASE WHEN "rank">100 THEN points END) AS below, min(CASE WHEN "rank"<=100 THEN points END) AS above FROM loc)
SELECT round(slope,6) AS slope, round(intercept,4) AS intercept, round(r2,6) AS r2, anchors, round((ln(100e0)-intercept)/slope,4) AS cutoff, coalesce(below,floor((ln(100e0)-intercept)/slope)) AS observed_lower, coalesce(above,ceil((ln(100e0)-intercept)/slope)) AS observed_upper, greatest(round((ln(100e0)-intercept)/slope),coalesce(above,ceil((ln(100e0)-intercept)/slope))) AS target_points FROM f""")
def g17(spark, sf):
    out = g.rank_fit(anchors(spark, sf), 100)
    return out.select(
        r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2").alias("r2"), "anchors", F.round("cutoff", 4).alias("cutoff"),
        "observed_lower", "observed_upper", "target_points",
    )


def scramble_sql(seed, *parts) -> str:
    state = f"{seed}::BIGINT"
    for p in parts:
        state = f"((((({state}+({p})::BIGINT+1)*48271)%2147483647)+12345)*39373%2147483647)"
    return state


@query("G18_bootstrap", ANCHOR + f""", d AS (SELECT rep, ({scramble_sql(7, 'rep', 'i')}) % n AS i FROM loc, (SELECT count(*) AS n FROM loc), range(0,1200) t(rep)),
f AS (SELECT rep, regr_slope(log_rank, points) AS s, regr_intercept(log_rank, points) AS c FROM d JOIN loc ON loc.i=d.i GROUP BY rep HAVING regr_slope(log_rank, points)<-1e-5), c AS (SELECT (ln(100e0)-c)/s AS cutoff FROM f)
SELECT count(*) AS valid, round(quantile_cont(cutoff,0.05),4) AS lower, round(quantile_cont(cutoff,0.95),4) AS upper FROM c""")
def g18(spark, sf):
    return g.bootstrap_cutoff(anchors(spark, sf), 100).select("valid", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("G19_block_bootstrap", PANEL + f""", tt AS (SELECT stratum, period, CAST(sum(points) AS BIGINT) AS v FROM panel GROUP BY ALL), nn AS (SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY period)-1 AS i, v, count(*) OVER (PARTITION BY stratum) AS n FROM tt),
sl AS (SELECT stratum, n, s, i AS j FROM nn, range(0,4000) q(s)), dr AS (SELECT stratum, s, ({scramble_sql(11, 's', 'j//4')}) % (n-3) + j%4 AS i FROM sl), rp AS (SELECT d.stratum, s, sum(v) AS total FROM dr d JOIN nn ON nn.stratum=d.stratum AND nn.i=d.i GROUP BY ALL)
SELECT stratum, round(avg(CASE WHEN total>=5000+({scramble_sql(12, 's')})%5001 THEN 1e0 ELSE 0e0 END),6) AS probability, round(avg(total),6) AS mean_total FROM rp GROUP BY stratum""")
def g19(spark, sf):
    totals = panel(spark, sf).groupBy("stratum", "period").agg(F.sum("points").alias("points"))
    out = g.block_bootstrap(totals, "stratum", "period", "points", 5000, 10000)
    return rounded(out, ["stratum"], ["probability", "mean_total"])


PAIRED = PANEL + """, sp AS (SELECT side, period, sum(points)*1e0 AS p FROM panel GROUP BY ALL), hd AS (SELECT period, p AS h FROM sp WHERE side=0),
dl AS (SELECT side, p-h-1e0 AS d FROM sp JOIN hd USING (period) WHERE side<>0), qs AS (SELECT side, quantile_cont(d,0.1) AS q10, quantile_cont(d,0.5) AS md FROM dl GROUP BY side),
mn AS (SELECT side, count(*) AS n, avg(d) AS mean, avg(CASE WHEN d>0 THEN 1e0 ELSE 0e0 END) AS win, stddev_samp(d) AS sd FROM dl GROUP BY side), tl AS (SELECT dl.side, avg(d) AS cvar FROM dl JOIN qs ON qs.side=dl.side AND d<=q10 GROUP BY ALL),
ev AS (SELECT side, mean, md AS median, win, q10, cvar, sd/sqrt(n) AS se, mean-0.75e0*sd/sqrt(n) AS lower FROM mn JOIN qs USING (side) JOIN tl USING (side)),
ea AS (SELECT *, lower-0.35e0*(side/50e0) AS utility FROM ev), eb AS (SELECT *, mean>=0.25 AND win>=0.57 AND cvar>=-40 AND utility>0 AS passes FROM ea)
"""


def paired(spark, sf):
    by_side = panel(spark, sf).groupBy("side", "period").agg(F.sum("points").alias("p"))
    hold = by_side.where(F.col("side") == 0).select("period", F.col("p").alias("h"))
    draws = by_side.where(F.col("side") != 0).join(hold, "period").select(
        "side", (F.col("p") - F.col("h") - 1.0).alias("delta"), (F.col("side") / 50.0).alias("disagreement")
    )
    return g.paired_actions(draws, "side", "delta", ["disagreement"], {**g.ACTION_GATE, "cvar": -40.0})


@query("G20_paired_actions", PAIRED + "SELECT side, round(mean,6) AS mean, round(median,6) AS median, round(win,6) AS win, round(q10,6) AS q10, round(cvar,6) AS cvar, round(se,6) AS se, round(lower,6) AS lower, round(utility,6) AS utility, passes FROM eb")
def g20(spark, sf):
    return rounded(paired(spark, sf), ["side", "passes"], ["mean", "median", "win", "q10", "cvar", "se", "lower", "utility"])


@query("G20_choose_action", PAIRED + "SELECT coalesce((SELECT CAST(side AS VARCHAR) FROM eb WHERE passes ORDER BY utility DESC, mean DESC LIMIT 1),'Hold') AS chosen, (SELECT count(*) FROM eb) AS actions")
def g20b(spark, sf):
    return g.choose_action(paired(spark, sf), "side")


@query("G21_doubly_robust", "WITH i AS (SELECT value/80e0+((event_id%7)/6e0)/((1+event_id%9)/10e0)*(value/100e0-value/90e0) AS i FROM events) SELECT count(*) AS rows, round(avg(i),6) AS value, round(stddev_samp(i)/sqrt(count(*)),6) AS standard_error FROM i")
def g21(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    out = g.doubly_robust(table(spark, sf, "events"), v / 100.0, (1 + i % 9) / 10.0, (i % 7) / 6.0, v / 90.0, v / 80.0)
    return rounded(out, ["rows"], ["value", "standard_error"])


@query("G22_support_audit", "SELECT count(*) AS rows, count(DISTINCT event_type) AS policies, 'behaviour_propensity,q_logged,q_target,target_probability' AS missing, false AS identified FROM events")
def g22(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("action"), F.col("value").alias("reward"), "event_type")
    return g.support_audit(log, "event_type")


EPOCHS = PANEL + ", et AS (SELECT stratum, epoch, CAST(sum(points) AS BIGINT) AS total FROM panel GROUP BY ALL)"


def epoch_totals(spark, sf):
    return panel(spark, sf).groupBy("stratum", "epoch").agg(F.sum("points").alias("total"))


@query("G23_epoch_summary", EPOCHS + """, nb AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY epoch) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM et), u AS (SELECT nb.*, i<=n-2 AS dev, nb.total-b.total AS d FROM nb JOIN et b ON b.stratum='ASIA' AND b.epoch=nb.epoch WHERE i>2)
SELECT stratum, round(avg(total),6) AS average, CAST(min(total) AS DOUBLE) AS minimum, round(avg(total) FILTER (dev),6) AS development, round(avg(total) FILTER (NOT dev),6) AS holdout, round(avg(d),6) AS delta, round(avg(d) FILTER (dev),6) AS development_delta, round(avg(d) FILTER (dev)-0.2e0*stddev_pop(d) FILTER (dev),6) AS stability, round(avg(d) FILTER (NOT dev),6) AS holdout_delta, CAST(min(d) AS DOUBLE) AS worst, count(*) FILTER (d>0) AS positive, count(*) FILTER (d<0) AS negative FROM u GROUP BY stratum""")
def g23(spark, sf):
    out = g.epoch_summary(epoch_totals(spark, sf), "stratum", "epoch", "total", "ASIA")
    return rounded(out, ["stratum", "minimum", "worst", "positive", "negative"], ["average", "development", "holdout", "delta", "development_delta", "stability", "holdout_delta"])


@query("G24_integrity_audit", PANEL + """, ti AS (SELECT period, side, min(slate) AS least, max(slate) AS most, max(CASE WHEN lines>=12 THEN 2 ELSE slate END) AS planned FROM panel GROUP BY ALL) SELECT * FROM ti WHERE least<>planned OR most<>planned""")
def g24(spark, sf):
    p = panel(spark, sf).withColumn("scheduled", F.when(F.col("lines") >= 12, 2).otherwise(F.col("slate")))
    return g.integrity_mismatches(p, ["period"], "side", "slate", "scheduled")


@query("G24_mass_blanks", PANEL + """, b AS (SELECT period, count(*) FILTER (slate<=1) AS blank, count(*) AS registered FROM panel GROUP BY 1), a AS (SELECT period, count(DISTINCT side) AS active FROM panel WHERE slate>2 GROUP BY 1)
SELECT period, coalesce(active,0) AS active, blank, registered, round(blank/registered::DOUBLE,6) AS share, coalesce(active,0)<=12 AS explained FROM b LEFT JOIN a USING (period) WHERE blank/registered::DOUBLE>=0.4""")
def g24b(spark, sf):
    p = panel(spark, sf).select("period", "side", (F.col("slate") - 1).alias("slate"), (F.col("slate") - 2).alias("scheduled"))
    return rounded(g.mass_blanks(p, ["period"], "side", "slate", "scheduled"), ["period", "active", "blank", "registered", "explained"], ["share"])


@query("G25_cause_shares", FORECASTS + """, x AS (SELECT CASE WHEN slate=0 THEN 'no-show' WHEN minutes<60 THEN 'reduced' ELSE 'returns' END AS cause, lines*0.5e0 AS wt, f_base-points AS e FROM fp), c AS (SELECT cause, count(*) AS rows, sum(wt) AS weight, sum(abs(e)*wt) AS a, sum(e*wt) AS s FROM x GROUP BY cause)
SELECT cause, rows, round(weight,6) AS weight, round(a/sum(a) OVER (),6) AS share, round(s/weight,6) AS bias FROM c""")
def g25(spark, sf):
    cause = F.when(F.col("slate") == 0, "no-show").when(F.col("minutes") < 60, "reduced").otherwise("returns")
    out = g.cause_shares(forecasts(spark, sf).withColumn("cause", cause), "cause", F.col("f_base") - F.col("points"), F.col("lines") * 0.5)
    return rounded(out, ["cause", "rows"], ["weight", "share", "bias"])


@query("G26_snapshot_diff", f"""WITH c AS (SELECT user_id, {DAY} AS capture, string_agg(event_type||'/'||CAST(floor(value/200) AS INTEGER), ',' ORDER BY event_type, floor(value/200)) AS body, count(*) AS rows FROM events GROUP BY ALL), d AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY capture) AS was FROM c)
SELECT user_id, capture, rows, coalesce(body<>was, false) AS changed FROM d""")
def g26(spark, sf):
    from ..sources.snapshots import capture_changes
    shaped = table(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("capture"), "event_type", F.floor(F.col("value") / 200).alias("level"))
    return capture_changes(shaped, ["user_id"], "capture", ["event_type", "level"]).select("user_id", "capture", "rows", "changed")


@query("G27_covariance_screen", FORECASTS + """, c AS (SELECT 'a' AS name, 0.5e0 AS w1, 0.3e0 AS w2, 0.2e0 AS w3 UNION ALL SELECT 'b', 0.1e0, 0.1e0, 0.8e0 UNION ALL SELECT 'c', 0e0, 0e0, 0e0), s AS (SELECT epoch, name, corr(w1*f_base+w2*f_exp+w3*f_price, points) AS r, max(w1) AS w FROM fp, c GROUP BY ALL)
SELECT epoch, name, round(CASE WHEN name='c' THEN 0 ELSE r END,6) AS score FROM s""")
def g27(spark, sf):
    candidates = spark.createDataFrame([("a", [0.5, 0.3, 0.2]), ("b", [0.1, 0.1, 0.8]), ("c", [0.0, 0.0, 0.0])], "name string, weights array<double>")
    out = g.covariance_screen(forecasts(spark, sf), "epoch", ["f_base", "f_exp", "f_price"], "points", candidates)
    return rounded(out, ["epoch", "name"], ["score"])


@query("G28_scoreboard", f"""WITH s AS (SELECT user_id, {DAY} AS period, arg_min(CAST(floor(value) AS BIGINT), event_id) AS points, count(*)-1 AS rejected FROM events GROUP BY ALL)
SELECT user_id, period, points, rejected, CAST(sum(points) OVER (PARTITION BY user_id ORDER BY period) AS BIGINT) AS cumulative FROM s""")
def g28(spark, sf):
    scores = table(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("period"), F.floor("value").alias("points"), "event_id")
    return g.scoreboard(scores, "user_id", "period", "points", F.col("event_id"))


@query("G29_margin_to_benchmark", PANEL + """, t AS (SELECT entity, epoch, CAST(sum(points) AS BIGINT) AS total FROM panel GROUP BY ALL), b AS (SELECT epoch, CAST(floor(avg(total)) AS BIGINT) AS target FROM t GROUP BY epoch)
SELECT entity, epoch, total, total-target AS margin, total>=target AS hit, CASE WHEN abs(total-target)<=20 THEN greatest(1,CAST(round(500000*exp(-0.02e0*(total-target))) AS BIGINT)) END AS estimated_rank, CASE WHEN total>=target THEN 'above' WHEN total-target>=-20 THEN 'near' ELSE 'below' END AS band FROM t JOIN b USING (epoch)""")
def g29(spark, sf):
    totals = panel(spark, sf).groupBy("entity", "epoch").agg(F.sum("points").alias("total"))
    bench = totals.groupBy("epoch").agg(F.floor(F.avg("total")).alias("target")).withColumn("log_slope", F.lit(-0.02))
    return g.margin_to_benchmark(totals, bench, "epoch", "total", near=20)


@query("G30_robust_scale", FORECASTS + "SELECT position, round(greatest(2e0,1.4826e0*quantile_cont(abs(points-f_base),0.5)),6) AS scale FROM fp GROUP BY position")
def g30(spark, sf):
    return rounded(g.robust_scale(forecasts(spark, sf), ["position"], F.col("points") - F.col("f_base"), 2.0), ["position"], ["scale"])


@query("G31_model_disagreement", FORECASTS + "SELECT entity, period, round(list_stddev_pop([f_base,f_exp,f_price]),6) AS disagreement FROM fp")
def g31(spark, sf):
    return forecasts(spark, sf).select(*KEY, r6(population_std(["f_base", "f_exp", "f_price"])).alias("disagreement"))


@query("G32_fixture_peers", FORECASTS + """, r AS (SELECT *, rank() OVER (PARTITION BY period, opponent ORDER BY f_base DESC) AS fixture_rank, row_number() OVER (PARTITION BY period, opponent ORDER BY selected DESC, entity) AS k FROM fp)
SELECT a.entity, a.period, a.fixture_rank, coalesce(CASE WHEN a.k=1 THEN c.entity ELSE b.entity END, a.entity) AS rival FROM r a LEFT JOIN r b ON b.period=a.period AND b.opponent=a.opponent AND b.k=1 LEFT JOIN r c ON c.period=a.period AND c.opponent=a.opponent AND c.k=2""")
def g32(spark, sf):
    return g.fixture_peers(forecasts(spark, sf), ["period", "opponent"], "entity", "f_base", "selected").select(*KEY, "fixture_rank", "rival")


STABLE = PANEL + ", em AS (SELECT entity, epoch, avg(points) AS m FROM panel GROUP BY ALL), st AS (SELECT entity, avg(m)-0.25e0*stddev_pop(m) AS stability FROM em GROUP BY entity)"


def stability(spark, sf):
    per_epoch = panel(spark, sf).groupBy("entity", "epoch").agg(F.avg("points").alias("m"))
    return per_epoch.groupBy("entity").agg((F.avg("m") - 0.25 * F.stddev_pop("m")).alias("stability"))


@query("G33_leaderboard", STABLE + " SELECT entity, round(stability,6) AS stability FROM st ORDER BY st.stability DESC, entity LIMIT 5")
def g33(spark, sf):
    return g.leaderboard(stability(spark, sf), "entity", "stability").select("entity", r6("stability").alias("stability"))


@query("G33_score_curve", STABLE + ", o AS (SELECT stability, row_number() OVER (ORDER BY stability)-1 AS i, count(*) OVER () AS n FROM st) SELECT CAST(k AS INTEGER) AS k, round(stability,6) AS score FROM o, range(0,16) t(k) WHERE i=floor(k*(n-1)/15)")
def g33b(spark, sf):
    return g.score_curve(stability(spark, sf), "stability").select("k", r6("score").alias("score"))
