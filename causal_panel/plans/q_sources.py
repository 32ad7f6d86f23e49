"""Reads, registers, fingerprints, snapshots and reports (inventory group S)."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers, snapshots
from ..sources.scratch import scratch
from .bindings import PANEL, panel, table
from .registry import query, r6

RAW = T.StructType([
    T.StructField("element", T.LongType()), T.StructField("GW", T.IntegerType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("discount", T.DoubleType()), T.StructField("flag", T.StringType()),
])


@query("S1_read_epochs", """WITH x AS (SELECT l_suppkey AS element, CAST(month(l_shipdate) AS INTEGER) AS GW, CASE WHEN l_linenumber=7 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity, CASE WHEN year(l_shipdate)<1998 THEN 0e0 ELSE l_discount END AS discount, CASE WHEN year(l_shipdate)<1998 THEN l_returnflag END AS flag, CASE WHEN year(l_shipdate)<1998 THEN 'early' ELSE 'late' END AS season FROM lineitem WHERE l_linenumber<>1)
SELECT season, element, GW AS gw, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(discount),4) AS discount, count(flag) AS flags FROM x GROUP BY ALL""")
def s1(spark, sf):
    """Two epochs written with different headers and bad cells, then read under one schema."""
    line = table(spark, sf, "lineitem")
    key = F.when(F.col("l_linenumber") != 1, F.col("l_suppkey"))
    quantity = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    shaped = line.select(F.year("l_shipdate").alias("_y"), key.alias("element"), F.month("l_shipdate").alias("GW"), quantity.alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
    root = scratch(spark, "epochs")
    paths = {"early": f"{root}/early", "late": f"{root}/late"}
    shaped.where("_y < 1998").select("element", "GW", "quantity", "flag").write.option("header", True).csv(paths["early"])
    shaped.where("_y >= 1998").select("GW", "discount", "element", "quantity").write.option("header", True).csv(paths["late"])
    read = readers.read_epochs(spark, paths, RAW, ["element", "GW"])
    return read.groupBy("season", "element", F.col("GW").alias("gw")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"), F.round(F.sum("discount"), 4).alias("discount"), F.count("flag").alias("flags")
    )


NESTED = "array<struct<name: string, runners: array<struct<side: string, odds: double>>>>"


@query("S2_explode_path", PANEL + """SELECT entity, period, 'goals' AS market, unnest(['back','lay']) AS side, unnest([goals*1e0, assists*1e0]) AS odds FROM panel WHERE slate>0
 UNION ALL SELECT entity, period, 'empty', NULL, NULL FROM panel WHERE slate>0 UNION ALL SELECT entity, period, NULL, NULL, NULL FROM panel WHERE slate=0""")
def s2(spark, sf):
    runner = [F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("odds")) for s, c in (("back", "goals"), ("lay", "assists"))]
    none = F.array().cast("array<struct<side: string, odds: double>>")
    market = F.array(F.struct(F.lit("goals").alias("name"), F.array(*runner).alias("runners")), F.struct(F.lit("empty").alias("name"), none.alias("runners")))
    payload = panel(spark, sf).select("entity", "period", F.when(F.col("slate") > 0, F.to_json(market)).alias("markets"))
    rows = readers.explode_path(readers.parse_json(payload, "markets", NESTED), ["markets", "runners"], ["entity", "period"])
    return rows.select("entity", "period", F.col("market.name").alias("market"), F.col("runner.side").alias("side"), F.col("runner.odds").alias("odds"))


@query("S3_register", """SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderkey%11<>0 AND o_orderkey%7<>0 GROUP BY 1""")
def s3(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.when(F.col("o_orderkey") % 7 == 0, F.lit("unknown")).otherwise(F.col("o_custkey").cast("string"))
    raw = orders.select(key.alias("k"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderkey")
    return readers.register(raw, "k", ["o_orderpriority"], F.col("o_orderkey"))


@query("S4_first_available", "SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN o_totalprice END AS price FROM orders")
def s4(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("n/a").alias("AvgH"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("BbAvH"), F.lit(1.5).alias("B365H")
    )
    return readers.first_available(orders, ["PSH", "AvgH", "BbAvH", "B365H"], "price", forbidden=["AvgCH"]).select("o_orderkey", "price")


@query("S5_materialize", PANEL + "SELECT entity, period, points, CAST(2 AS INTEGER) AS readings FROM panel WHERE epoch=2")
def s5(spark, sf):
    path = scratch(spark, "features")
    features = panel(spark, sf).select("entity", "period", "epoch", "points")
    snapshots.materialize(features, path, "v1", "epoch", ["entity", "period", "points"])
    again = snapshots.materialize(features, path, "v1", "epoch", ["entity", "period", "points"])
    return again.where(F.col("epoch") == 2).select("entity", "period", "points", F.lit(2).alias("readings"))


@query("S6_fingerprint", PANEL + """SELECT epoch, count(*) AS rows, true AS same_when_shuffled, epoch NOT IN (SELECT epoch FROM panel WHERE slate=0) AS same_when_changed FROM panel GROUP BY epoch""")
def s6(spark, sf):
    cols = ["entity", "period", "points"]
    p = panel(spark, sf)
    one = snapshots.fingerprint(p, cols, "v1", ["epoch"])
    two = snapshots.fingerprint(p.repartition(7, "points"), cols, "v1", ["epoch"]).select("epoch", F.col("fingerprint").alias("f2"))
    changed = p.withColumn("points", F.when(F.col("slate") == 0, F.col("points") + 1).otherwise(F.col("points")))
    three = snapshots.fingerprint(changed, cols, "v1", ["epoch"]).select("epoch", F.col("fingerprint").alias("f3"))
    return one.join(two, "epoch").join(three, "epoch").select(
        "epoch", "rows", (F.col("fingerprint") == F.col("f2")).alias("same_when_shuffled"), (F.col("fingerprint") == F.col("f3")).alias("same_when_changed")
    )


@query("S7_append_snapshot", PANEL + """SELECT entity, period, sha256('{"entity":'||entity||',"period":'||period||',"points":'||points||'}') AS content_hash FROM panel""")
def s7(spark, sf):
    path = scratch(spark, "snapshots")
    payload = ["entity", "period", "points"]
    rows = panel(spark, sf).select(*payload, "epoch")
    snapshots.append_snapshot(rows.where("epoch < 3"), path, payload, ["epoch"])
    fresh = snapshots.new_snapshots(rows, path, payload).drop("content_hash")
    snapshots.append_snapshot(fresh, path, payload, ["epoch"])
    return snapshots.read_snapshots(spark, path).select("entity", "period", "content_hash")


@query("S8_write_report", PANEL + "SELECT stratum, count(*) AS rows, round(avg(points),6) AS average FROM panel GROUP BY stratum")
def s8(spark, sf):
    path = scratch(spark, "report")
    metrics = panel(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("points")).alias("average"))
    snapshots.write_report(metrics, path)
    return spark.read.schema("stratum string, rows bigint, average double").json(path)
