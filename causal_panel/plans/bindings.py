"""Panels derived from the given tables, as DataFrames and as the same SQL text.

The panel is one row per supplier (entity) and shipping month (period). Points are
whole numbers, so sums and means do not depend on the order rows are added in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Starting forecast by position.
START_FORECAST = {1: 3.2, 2: 2.6, 3: 2.8, 4: 2.6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier dimension with nation (side) and region (stratum)."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    # nation and region have 25 and 5 rows whatever the scale
    places = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("entity"),
        F.col("s_nationkey").cast("int").alias("side"),
        F.col("r_name").alias("stratum"),
        (F.col("r_regionkey") % 4 + 1).cast("int").alias("position"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    cents = F.floor(
        F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5
    ).cast("bigint")

    def tally(test):
        return F.count(F.when(test, 1)).cast("int")

    rolled = line.groupBy(
        F.col("l_suppkey").alias("entity"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("period"),
        (F.year("l_shipdate") - 1995).cast("int").alias("epoch"),
    ).agg(
        F.sum(cents).alias("_cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("_qty"),
        F.count(F.lit(1)).cast("int").alias("lines"),
        tally(F.col("l_quantity") > 35).alias("slate"),
        F.floor(F.max("l_extendedprice") / 1000).cast("int").alias("_top"),
        (F.min("l_partkey") % 25).cast("int").alias("opponent"),
        tally(F.col("l_returnflag") == "R").alias("goals"),
        tally(F.col("l_returnflag") == "A").alias("assists"),
        tally(F.col("l_linestatus") == "F").alias("clean"),
        F.sum("l_linenumber").cast("int").alias("saves"),
        tally(F.col("l_discount") > 0.065).alias("conceded"),
        tally(F.col("l_tax") > 0.065).alias("bonus"),
        F.sum(F.col("l_orderkey") % 1000).alias("selected"),
        F.sum(F.col("l_orderkey") % 200 - 100).alias("transfers"),
    )
    shaped = rolled.select(
        "entity", "period", "epoch", "slate", "lines", "opponent",
        F.expr("cast(_cents div 5000000 as int)").alias("points"),
        F.least(F.expr("cast(_qty div 2 as int)"), F.lit(90)).alias("minutes"),
        (F.col("_top") + 35).alias("price"),
        "goals", "assists", "clean", "saves", "conceded", "bonus", "selected", "transfers",
        (F.col("lines") % 2 == 0).alias("is_home"),
    )
    return shaped.join(entities(spark, sf_dir), "entity")


PANEL = """WITH rolled AS (
 SELECT l_suppkey AS entity,
  CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS INTEGER) AS period,
  CAST(year(l_shipdate)-1995 AS INTEGER) AS epoch,
  CAST(sum(CAST(floor(l_extendedprice*(1-l_discount)*100+0.5) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
  CAST(count(*) AS INTEGER) AS lines,
  CAST(count(*) FILTER (l_quantity > 35) AS INTEGER) AS slate,
  CAST(floor(max(l_extendedprice)/1000) AS INTEGER) AS top_price,
  CAST(min(l_partkey) % 25 AS INTEGER) AS opponent,
  CAST(count(*) FILTER (l_returnflag='R') AS INTEGER) AS goals,
  CAST(count(*) FILTER (l_returnflag='A') AS INTEGER) AS assists,
  CAST(count(*) FILTER (l_linestatus='F') AS INTEGER) AS clean,
  CAST(sum(l_linenumber) AS INTEGER) AS saves,
  CAST(count(*) FILTER (l_discount > 0.065) AS INTEGER) AS conceded,
  CAST(count(*) FILTER (l_tax > 0.065) AS INTEGER) AS bonus,
  CAST(sum(l_orderkey % 1000) AS BIGINT) AS selected,
  CAST(sum(l_orderkey % 200 - 100) AS BIGINT) AS transfers
 FROM lineitem GROUP BY 1,2,3),
ents AS (SELECT s_suppkey AS entity, CAST(s_nationkey AS INTEGER) AS side, r_name AS stratum,
  CAST(r_regionkey % 4 + 1 AS INTEGER) AS position
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
panel AS (SELECT r.entity, period, epoch, slate, lines, opponent,
  CAST(cents // 5000000 AS INTEGER) AS points, CAST(least(qty // 2, 90) AS INTEGER) AS minutes,
  top_price + 35 AS price, goals, assists, clean, saves, conceded, bonus, selected, transfers,
  lines % 2 = 0 AS is_home, side, stratum, position
 FROM rolled r JOIN ents e ON r.entity=e.entity)
"""


def _prior(rows: int | None):
    start = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy("entity").orderBy("period").rowsBetween(start, -1)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel plus three forecasts, a probability and an uncertainty known before the period."""
    base = panel(spark, sf_dir)
    start = F.lit(None).cast("double")
    for position, value in START_FORECAST.items():
        start = F.when(F.col("position") == position, F.lit(value)).otherwise(start)
    seen = F.when(F.col("slate") > 0, F.col("points"))
    six, ever = _prior(6), _prior(None)
    return (
        base.withColumn("f_exp", F.coalesce(F.avg(seen).over(ever), start))
        .withColumn("f_base", F.coalesce(F.avg(seen).over(six), F.col("f_exp")))
        .withColumn("f_price", F.col("price") / F.lit(20.0))
        .withColumn("n_prior", F.count(seen).over(ever))
        .withColumn("prob", F.col("f_base") / (F.col("f_base") + 6.0))
        .withColumn("unc", F.lit(1.2) + F.col("f_price") / 10.0)
    )


FORECASTS = PANEL + """, fp0 AS (SELECT *,
  coalesce(avg(CASE WHEN slate>0 THEN points END) OVER (PARTITION BY entity ORDER BY period
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   CASE position WHEN 1 THEN 3.2::DOUBLE WHEN 2 THEN 2.6::DOUBLE WHEN 3 THEN 2.8::DOUBLE WHEN 4 THEN 2.6::DOUBLE END) AS f_exp,
  avg(CASE WHEN slate>0 THEN points END) OVER (PARTITION BY entity ORDER BY period
    ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS six,
  count(CASE WHEN slate>0 THEN points END) OVER (PARTITION BY entity ORDER BY period
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM panel),
fp1 AS (SELECT * EXCLUDE (six), coalesce(six, f_exp) AS f_base, price/20.0::DOUBLE AS f_price FROM fp0),
fp AS (SELECT *, f_base/(f_base+6.0::DOUBLE) AS prob, 1.2::DOUBLE + f_price/10.0::DOUBLE AS unc FROM fp1)
"""


def at_last_epoch(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earlier epochs, last epoch)."""
    last = df.agg(F.max("epoch").alias("_last_epoch"))  # one row
    marked = df.join(F.broadcast(last))
    return marked.where(F.col("epoch") < F.col("_last_epoch")).drop("_last_epoch"), marked.where(F.col("epoch") == F.col("_last_epoch")).drop("_last_epoch")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day (counted from 1970) of the event log; points are whole units of value."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("user_id").alias("entity"),
        F.unix_date(F.to_date("ts")).alias("period"),
    ).agg(
        F.sum(F.floor("value").cast("bigint")).alias("points"),
        F.count(F.lit(1)).cast("int").alias("slate"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).cast("int").alias("purchases"),
        F.count(F.when(F.col("event_type") == "error", 1)).cast("int").alias("errors"),
        F.min("ts").alias("first_ts"),
    ).withColumn("epoch", F.expr("cast(period div 7 as int)"))


# The day of an event, counted from 1970.
DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER)"

USER_DAYS = """WITH ud AS (SELECT user_id AS entity, """ + DAY + """ AS period,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS points, CAST(count(*) AS INTEGER) AS slate,
  CAST(count(*) FILTER (event_type='purchase') AS INTEGER) AS purchases,
  CAST(count(*) FILTER (event_type='error') AS INTEGER) AS errors, min(ts) AS first_ts,
  CAST(""" + DAY + """//7 AS INTEGER) AS epoch FROM events GROUP BY user_id, """ + DAY + """)
"""
