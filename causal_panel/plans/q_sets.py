"""Sorts, limits and set operations (inventory groups T and U)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets
from ..operators.windows import top_k
from .bindings import FORECASTS, PANEL, forecasts, panel, table
from .registry import query, r6

KEY = ["entity", "period"]


@query("T1_global_top_n", FORECASTS + "SELECT entity, period, points, round(abs(f_base-points),6) AS miss FROM fp ORDER BY abs(f_base-points) DESC, entity, period LIMIT 30")
def t1(spark, sf):
    fp = forecasts(spark, sf).withColumn("gap", F.abs(F.col("f_base") - F.col("points")))
    return sets.top_n(fp, [F.desc("gap"), F.asc("entity"), F.asc("period")], 30).select(*KEY, "points", r6("gap").alias("miss"))


@query("T2_top_k_per_group", PANEL + ", t AS (SELECT epoch, entity, CAST(sum(points) AS BIGINT) AS total FROM panel GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY epoch ORDER BY total DESC, entity) AS INTEGER) AS place FROM t) SELECT * FROM r WHERE place<=5")
def t2(spark, sf):
    totals = panel(spark, sf).groupBy("epoch", "entity").agg(F.sum("points").alias("total"))
    return top_k(totals, ["epoch"], [F.desc("total"), F.asc("entity")], 5, "place").select("epoch", "entity", "total", "place")


@query("T3_mixed_sort", """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey""")
def t3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(
        F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")
    )


@query("U1_perspectives", PANEL + "SELECT entity, period, side AS club, opponent AS rival, goals AS scored, conceded AS lost, true AS is_home FROM panel UNION ALL SELECT entity, period, opponent, side, conceded, goals, false FROM panel")
def u1(spark, sf):
    home = {"club": "side", "rival": "opponent", "scored": "goals", "lost": "conceded"}
    away = {"club": "opponent", "rival": "side", "scored": "conceded", "lost": "goals"}
    return sets.perspectives(panel(spark, sf), KEY, home, away)


@query("U2_keep_first", "SELECT l_suppkey, min(l_orderkey*100000+l_partkey) AS first_row FROM lineitem GROUP BY 1")
def u2(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("first_row"))
    return sets.keep_first(rows, ["l_suppkey"], [F.asc("first_row")])


@query("U3_set_comparison", PANEL + """, a AS (SELECT DISTINCT entity, epoch FROM panel WHERE points>=12), b AS (SELECT DISTINCT entity, epoch FROM panel WHERE slate>=6)
SELECT coalesce(a.entity,b.entity) AS entity, coalesce(a.epoch,b.epoch) AS epoch, CASE WHEN a.entity IS NULL THEN 'right' WHEN b.entity IS NULL THEN 'left' ELSE 'both' END AS found FROM a FULL JOIN b ON a.entity=b.entity AND a.epoch=b.epoch""")
def u3(spark, sf):
    p = panel(spark, sf)
    return sets.set_comparison(p.where("points >= 12"), p.where("slate >= 6"), ["entity", "epoch"])
