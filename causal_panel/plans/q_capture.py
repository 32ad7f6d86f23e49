"""Deadline gates, append-once and overlays over the event log (inventory group K)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import capture as k
from .bindings import DAY, table
from .registry import query, r6


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a file stream; the schema comes from the file's footer."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def as_captures(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    fields = F.when(kind == "error", F.array(F.lit("fixtures"), F.lit("points"))).otherwise(F.array(F.lit("fixtures"), F.lit("prices")))
    return events.select(
        "event_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("captured_at"),
        F.when(kind == "signup", "recollected").otherwise("exact-capture").alias("timing"), fields.alias("fields"),
        F.when(F.col("value") > 30, "locked").when(F.col("value") > 5, "provisional").otherwise("draft").alias("decision_status"),
    )


def deadlines(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    return days.select(F.col("d").alias("day"), (F.col("d").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("deadline"))


GATE = """WITH c AS (SELECT event_id, CASE WHEN event_id%50<>0 THEN ts END AS cap, date_trunc('day', ts)+INTERVAL 18 HOUR AS dl, event_type='error' AS bad, event_type<>'signup' AS exact, CASE WHEN value>30 THEN 'locked' WHEN value>5 THEN 'provisional' ELSE 'draft' END AS st FROM events),
g AS (SELECT *, coalesce(cap<=dl,false) AS bf FROM c), o AS (SELECT event_id, concat_ws('|', CASE WHEN bad THEN 'forbidden-field' END, CASE WHEN exact AND NOT bf THEN 'captured-after-deadline' END) AS errors, exact AND bf AND NOT bad AND st IN ('provisional','locked') AS shadow_eligible, exact AND bf AND NOT bad AND st='locked' AS promotion_eligible FROM g)
"""


@query("K1_deadline_gate", GATE + "SELECT * FROM o")
def k1(spark, sf):
    gated = k.deadline_gate(as_captures(table(spark, sf, "events")), deadlines(spark, sf), ["day"])
    return gated.select("event_id", F.array_join("errors", "|").alias("errors"), "shadow_eligible", "promotion_eligible")


@query("K1_deadline_gate_stream", GATE + "SELECT event_id, errors, shadow_eligible, promotion_eligible, errors<>'' AS quarantined FROM o")
def k1s(spark, sf):
    root = scratch(spark, "gate")
    k.run_gate(as_captures(event_stream(spark, sf)), deadlines(spark, sf), ["day"], f"{root}/accepted", f"{root}/quarantine", f"{root}/checkpoint")
    both = spark.read.parquet(f"{root}/accepted").withColumn("quarantined", F.lit(False)).unionByName(
        spark.read.parquet(f"{root}/quarantine").withColumn("quarantined", F.lit(True))
    )
    return both.select("event_id", F.array_join("errors", "|").alias("errors"), "shadow_eligible", "promotion_eligible", "quarantined")


@query("K2_lock_once", f"SELECT user_id, {DAY} AS day, min(event_id) AS event_id, count(*)-1 AS rejected FROM events GROUP BY ALL")
def k2(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"), "event_id")
    return k.lock_once_batch(rows, ["user_id", "day"], F.col("event_id"))


@query("K2_lock_once_stream", f"SELECT user_id, {DAY} AS day, first(event_id ORDER BY ts, event_id) AS event_id, count(*)-1 AS rejected FROM events GROUP BY ALL")
def k2s(spark, sf):
    root = scratch(spark, "locks")
    rows = event_stream(spark, sf).select("user_id", F.unix_date(F.to_date("ts")).alias("day"), "ts", "event_id")
    k.run_lock_once(rows, ["user_id", "day"], ["ts", "event_id"], f"{root}/locked", f"{root}/rejected", f"{root}/checkpoint")
    refused = spark.read.parquet(f"{root}/rejected").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("rejected"))
    locked = spark.read.parquet(f"{root}/locked").join(refused, ["user_id", "day"], "left")
    return locked.select("user_id", "day", "event_id", F.coalesce("rejected", F.lit(0)).alias("rejected"))


def projections(spark, sf):
    """A projection for every customer; those who never met an event keep it."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 != 0, 80.0).alias("previous_chance"), F.lit(60.0).alias("probability"),
        F.floor(F.abs("c_acctbal") / 100).cast("double").alias("minutes"), (F.floor("c_acctbal") / 100.0).alias("projected"),
    )


OVERLAY = """WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey%4<>0 THEN 80e0 ELSE 100e0 END AS pc, 60e0 AS pr, floor(abs(c_acctbal)/100)*1e0 AS mi, floor(c_acctbal)/100e0 AS pj FROM customer), l AS (SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 0e0 WHEN 'view' THEN 50e0 ELSE 100e0 END, ts) AS ch FROM events GROUP BY 1),
r AS (SELECT p.*, ch, least(1.25e0,greatest(0,ch/greatest(pc,1))) AS ra FROM p LEFT JOIN l USING (user_id)), s AS (SELECT *, floor(greatest(mi,1)*ra+0.5e0) AS af FROM r)
SELECT user_id, ch IS NOT NULL AS updated, CASE WHEN ch IS NULL THEN pr ELSE floor(least(98,pr*ra)+0.5e0) END AS probability, CASE WHEN ch IS NULL THEN mi ELSE af END AS minutes, round(CASE WHEN ch IS NULL THEN pj ELSE pj*least(1.25e0,greatest(0,af/greatest(mi,1))) END,6) AS projected FROM s"""


def statuses(events: DataFrame) -> DataFrame:
    chance = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "view", 50.0).otherwise(100.0)
    return events.select("user_id", "ts", chance.alias("chance"))


@query("K3_status_overlay", OVERLAY)
def k3(spark, sf):
    latest = k.latest_status(statuses(table(spark, sf, "events")), "user_id", "ts", ["chance"])
    return k.overlay_status(projections(spark, sf), latest, "user_id").withColumn("projected", r6("projected"))


@query("K3_status_overlay_stream", OVERLAY)
def k3s(spark, sf):
    root = scratch(spark, "status")
    k.run_status_log(statuses(event_stream(spark, sf)), "user_id", "ts", ["chance"], f"{root}/log", f"{root}/checkpoint")
    latest = k.latest_status(spark.read.parquet(f"{root}/log"), "user_id", "ts", ["chance"])
    return k.overlay_status(projections(spark, sf), latest, "user_id").withColumn("projected", r6("projected"))


@query("K4_override_merge", """WITH o AS (SELECT event_id, value AS mi, (event_id%12)/10e0 AS st, CASE WHEN event_id%5<>0 THEN 0.6e0 END AS cf, CASE WHEN event_id%4<>0 THEN 'z' ELSE 'n' END AS zn, ts FROM events),
a AS (SELECT *, mi BETWEEN 0 AND 90 AND st BETWEEN 0 AND 1 AND zn='z' AND ts<=TIMESTAMP '2024-01-25 00:00:00' AS ok FROM o), m AS (SELECT event_id, 70e0 AS mm, 0.8e0 AS ms, CASE WHEN event_id%3=0 THEN 50e0 END AS ch, CASE WHEN event_id%9=0 THEN 'd' ELSE 'a' END AS sx, event_id%13=0 AS nw FROM events),
j AS (SELECT m.*, ok, mi, st, coalesce(cf,0.75e0) AS c, coalesce(ch,100e0)/100 AS f FROM m JOIN a USING (event_id)), r AS (SELECT *, CASE WHEN ok THEN c*mi+(1-c)*mm*f ELSE mm*f END AS em, CASE WHEN ok THEN c*st+(1-c)*ms*f ELSE ms*f END AS es FROM j)
SELECT event_id, round(em,6) AS expected_minutes, round(es,6) AS start_probability, round(abs(em-mm),6) AS disagreement, sx<>'a' OR abs(em-mm)>=12 OR ok OR nw AS priority FROM r""")
def k4(spark, sf):
    events = table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = events.select(
        "event_id", F.col("value").alias("minutes"), ((F.col("event_id") % 12) / 10.0).alias("start"), F.when(F.col("event_id") % 5 != 0, 0.6).alias("confidence"),
        F.when(F.col("event_id") % 4 != 0, F.concat(text, F.lit("Z"))).otherwise(text).alias("updated_at"),
    )
    admitted = k.admit_overrides(given, F.lit("2024-01-25 00:00:00+00:00").cast("timestamp"))
    model = events.select(
        "event_id", F.lit(70.0).alias("model_minutes"), F.lit(0.8).alias("model_start"), F.when(F.col("event_id") % 3 == 0, 50.0).alias("chance"),
        F.when(F.col("event_id") % 9 == 0, "d").otherwise("a").alias("status"), F.when(F.col("event_id") % 13 == 0, "late news").alias("news"),
    )
    out = k.merge_overrides(model, admitted, "event_id")
    return out.select("event_id", *[r6(c).alias(c) for c in ("expected_minutes", "start_probability", "disagreement")], "priority")


@query("K5_schedule_changes", f"""WITH c AS (SELECT user_id, {DAY} AS capture, string_agg(event_type, ',' ORDER BY event_type) AS body, count(*) AS rows FROM events GROUP BY ALL), d AS (SELECT *, lag(body) OVER (PARTITION BY user_id ORDER BY capture) AS was FROM c)
SELECT user_id, capture, rows, coalesce(body<>was, false) AS changed FROM d""")
def k5(spark, sf):
    root = scratch(spark, "schedule")
    shaped = event_stream(spark, sf).select("user_id", F.unix_date(F.to_date("ts")).alias("capture"), "event_type")
    k.run_change_log(shaped, ["user_id"], "capture", ["event_type"], f"{root}/log", f"{root}/checkpoint")
    out = k.changes_of(spark.read.parquet(f"{root}/log"), ["user_id"], "capture", ["event_type"])
    return out.select("user_id", "capture", "rows", "changed")
