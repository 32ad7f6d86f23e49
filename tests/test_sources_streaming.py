from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causal_panel.sources import readers, snapshots
from causal_panel.sources.scratch import scratch
from causal_panel.streaming import capture


def test_read_epochs_with_drift(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("element,GW,points,name\n1,1,5,Ag\xfcero\n,2,4,x\n2,2,bad,y\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("GW,element,xg,points\n3.0,7,0.4,\n")
    schema = T.StructType([T.StructField("element", T.LongType()), T.StructField("GW", T.IntegerType()), T.StructField("points", T.IntegerType()), T.StructField("xg", T.DoubleType()), T.StructField("name", T.StringType())])
    rows = readers.read_epochs(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}, schema, ["element", "GW"]).orderBy("season", "element").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 5, 0.0, "Ag\xfcero", "a"), (2, 2, 0, 0.0, "y", "a"), (7, 3, 0, 0.4, None, "b")]


def test_register_last_wins(spark):
    df = spark.createDataFrame([("5", "a", 1), ("5", "b", 2), ("x", "c", 3), ("6", None, 4)], "k string, v string, o int")
    assert [tuple(r) for r in readers.register(df, "k", ["v"], F.col("o")).collect()] == [(5, "b")]


def test_first_available_errors(spark):
    df = spark.createDataFrame([(None, "1.5")], "a string, b string")
    assert readers.first_available(df, ["zz", "a", "b"], "o").first()["o"] == 1.5
    with pytest.raises(ValueError):
        readers.first_available(df, ["b"], "o", forbidden=["b"])
    with pytest.raises(KeyError):
        readers.first_available(df, ["zz"], "o")
    with pytest.raises(KeyError):
        readers.first_available(df, ["a"], "o")


def test_fingerprint(spark):
    df = spark.range(50).selectExpr("id", "id * 2 as x")
    one = snapshots.fingerprint(df, ["id", "x"], "v1").first()["fingerprint"]
    assert one == snapshots.fingerprint(df.repartition(5).orderBy(F.desc("id")), ["id", "x"], "v1").first()["fingerprint"]
    assert one != snapshots.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))), ["id", "x"], "v1").first()["fingerprint"]
    with pytest.raises(KeyError):
        snapshots.fingerprint(df, ["nothing"], "v1")


def test_snapshot_is_append_only(spark):
    path = scratch(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    snapshots.append_snapshot(df, path, ["k", "v"])
    with pytest.raises(FileExistsError):
        snapshots.append_snapshot(df.limit(1), path, ["k", "v"])
    assert snapshots.new_snapshots(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, ["k", "v"]).count() == 1
    assert snapshots.read_snapshots(spark, path).count() == 2


def test_materialize_rewrites_stale_tables(spark):
    path = scratch(spark, "t")
    df = spark.createDataFrame([(1, 10, 0), (2, 20, 1)], "k int, v int, epoch int")
    snapshots.materialize(df, path, "v1", "epoch", ["k", "v"])
    changed = df.withColumn("v", F.col("v") + 1)
    assert snapshots.materialize(changed, path, "v1", "epoch", ["k", "v"]).agg(F.sum("v")).first()[0] == 32
    assert snapshots.materialize(df, path, "v1", "epoch", ["k", "v"]).agg(F.sum("v")).first()[0] == 30
    assert snapshots.materialize(changed, path, "v2", "epoch", ["k", "v"]).agg(F.sum("v")).first()[0] == 32


NOON, LATE = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 19)


@pytest.mark.parametrize("captured,fields,status,errors,shadow,promotion", [
    (NOON, ["fixtures", "prices"], "locked", [], True, True),
    (NOON, ["fixtures"], "provisional", [], True, False),
    (NOON, ["AvgCH", "points", "prices"], "locked", ["forbidden-field"], False, False),
    (None, ["fixtures"], "locked", ["captured-after-deadline"], False, False),
    (LATE, ["fixtures"], "locked", ["captured-after-deadline"], False, False),
])
def test_deadline_gate(spark, captured, fields, status, errors, shadow, promotion):
    rows = spark.createDataFrame([(1, captured, "exact-capture", fields, status)], "k int, captured_at timestamp, timing string, fields array<string>, decision_status string")
    due = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 18))], "k int, deadline timestamp")
    row = capture.deadline_gate(rows, due, ["k"]).first()
    assert (row["errors"], row["shadow_eligible"], row["promotion_eligible"]) == (errors, shadow, promotion)
    if "points" in fields:
        assert row["forbidden_fields"] == ["AvgCH", "points"]


def test_stream_restarts_where_it_stopped(spark):
    source, root = scratch(spark, "in"), scratch(spark, "out")
    schema = "k int, captured_at timestamp, timing string, fields array<string>, decision_status string"
    due = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 18))], "k int, deadline timestamp")

    def feed(at):
        spark.createDataFrame([(1, at, "exact-capture", ["prices"], "locked")], schema).write.mode("append").parquet(source)
        capture.run_gate(spark.readStream.schema(schema).parquet(source), due, ["k"], f"{root}/ok", f"{root}/bad", f"{root}/ck")
        return spark.read.parquet(f"{root}/ok").count(), spark.read.parquet(f"{root}/bad").count()

    assert feed(NOON) == (1, 0)
    assert feed(LATE) == (1, 1)
    assert feed(NOON) == (2, 1)


def test_overrides(spark):
    rows = [(1, 60.0, 0.5, None, "2024-01-01T00:00:00Z"), (2, 95.0, 0.5, 0.9, "2024-01-01T00:00:00Z"), (3, 60.0, 0.5, 0.9, "2024-01-01T00:00:00"), (4, 60.0, 0.5, 0.9, "2030-01-01T00:00:00+00:00")]
    given = spark.createDataFrame(rows, "k int, minutes double, start double, confidence double, updated_at string")
    out = capture.admit_overrides(given, F.lit("2024-06-01").cast("timestamp")).orderBy("k").collect()
    assert [r["errors"] for r in out] == [[], ["range"], ["no-zone"], ["future"]] and out[0]["confidence"] == 0.75


def test_the_latest_override_counts_once(spark):
    rows = [(1, 60.0, 0.5, 1.0, "2024-01-01T00:00:00Z"), (1, 30.0, 0.5, 1.0, "2024-01-02T00:00:00Z")]
    given = capture.admit_overrides(spark.createDataFrame(rows, "k int, minutes double, start double, confidence double, updated_at string"), F.lit("2024-06-01").cast("timestamp"))
    model = spark.createDataFrame([(1, 70.0, 0.8, None, "a", None), (2, 70.0, 0.8, None, "a", "knock"), (3, 70.0, 0.8, None, "a", " ")], "k int, model_minutes double, model_start double, chance double, status string, news string")
    out = capture.merge_overrides(model, given, "k").orderBy("k").collect()
    assert [(r["k"], r["expected_minutes"], r["priority"]) for r in out] == [(1, 30.0, True), (2, 70.0, True), (3, 70.0, False)]


def test_lock_once_forgets_nothing(spark):
    source, root = scratch(spark, "in"), scratch(spark, "out")
    schema = "k int, at timestamp, id int"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        capture.run_lock_once(spark.readStream.schema(schema).parquet(source), ["k"], ["at", "id"], f"{root}/ok", f"{root}/no", f"{root}/ck")
        return sorted(r["id"] for r in spark.read.parquet(f"{root}/ok").collect()), sorted(r["id"] for r in spark.read.parquet(f"{root}/no").collect())

    day = dt.timedelta(days=1)
    assert feed((1, LATE, 10), (1, NOON, 11), (1, NOON, 11), (2, NOON, 20)) == ([11, 20], [10, 11])
    assert feed((1, NOON - 90 * day, 12), (3, NOON - 90 * day, 30), (2, NOON + 90 * day, 21)) == ([11, 20, 30], [10, 11, 12, 21])


def test_deadlines_of_two_months(spark):
    from causal_panel.plans.q_capture import as_captures
    days = [dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=k) for k in range(60)]
    events = spark.createDataFrame([(k + 1, d, "purchase", 50.0) for k, d in enumerate(days)], "event_id int, ts timestamp_ntz, event_type string, value double")
    due = events.select(F.to_date("ts").alias("day"), (F.to_date("ts").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("deadline"))
    gated = capture.deadline_gate(as_captures(events), due, ["day"])
    assert gated.count() == 60 and gated.where("promotion_eligible").count() == 59  # event 50 has no capture time


def test_writers_at_once_never_store_a_row_twice(spark, tmp_path):
    """Overlapping, unequal batches from six threads: each row is stored once or its writer is refused, and what is refused leaves nothing."""
    from concurrent.futures import ThreadPoolExecutor

    from causal_panel.sources import snapshots

    path = f"{tmp_path}/store"

    def write(k: int) -> bool:
        rows = spark.range(k * 3, k * 3 + 5).select("id", (F.col("id") % 2).alias("epoch"))
        try:
            snapshots.append_snapshot(rows, path, ["id"], ["epoch"])
            return True
        except FileExistsError:
            return False

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(write, range(6)))
    stored = snapshots.read_snapshots(spark, path)
    ids = sorted(r.id for r in stored.select("id").collect())
    assert ids == sorted({i for k in range(6) if done[k] for i in range(k * 3, k * 3 + 5)}) and len(ids) == 5 * sum(done) and sum(done) >= 2
    assert set(stored.columns) == {"id", "epoch", "content_hash"}
    assert not write(done.index(True))


def test_locks_read_their_own_keys_only(spark, tmp_path):
    """Twelve micro-batches of new and old keys: the state decides, and no batch reads what was locked before."""
    source = f"{tmp_path}/in"
    for n in range(12):
        rows = [(k, n, f"d{n}") for k in range(n, n + 4)] + [(0, 100 + n, "late"), (n, None, "null")]
        spark.createDataFrame(rows, "k int, t int, what string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, t int, what string").parquet(source)
        capture.run_lock_once(stream, ["k"], ["t"], f"{tmp_path}/locked", f"{tmp_path}/rejected", f"{tmp_path}/checkpoint")
    locked = {(r.k, r.what) for r in spark.read.parquet(f"{tmp_path}/locked").collect()}
    assert locked == {(k, "d0") for k in range(4)} | {(k, f"d{k - 3}") for k in range(4, 15)}
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == 12 * 6 - 15


def test_locks_of_many_keys_need_no_python(spark, tmp_path):
    """A key costs no call into Python: its lock is Spark's own deduplication state. Equal rows, null keys and null instants keep their counts."""
    rows = spark.range(30_000).selectExpr("if(id % 10 = 0, null, id div 3) as k", "if(id % 7 = 0, null, (id * 37) % 101) as t", "id div 2 as what")
    (rows := rows.unionByName(rows)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    capture.run_lock_once(stream, ["k"], ["t", "what"], f"{tmp_path}/locked", f"{tmp_path}/rejected", f"{tmp_path}/checkpoint")
    state = spark.read.format("state-metadata").load(f"{tmp_path}/checkpoint").select("operatorName").distinct().collect()
    assert [r.operatorName for r in state] == ["dedupe"]
    assert [f.name for f in (tmp_path / "checkpoint" / "sources").iterdir()] == ["0"]  # one source: rows and marks come from the same listing
    locked, rejected = (spark.read.parquet(f"{tmp_path}/{x}").drop("batch") for x in ("locked", "rejected"))
    first = rows.groupBy("k").agg(F.min(F.struct(F.col("t").isNull().alias("late"), "t", "what")).alias("f")).selectExpr("k", "f.t", "f.what")
    assert locked.exceptAll(first).count() == 0 and first.exceptAll(locked).count() == 0
    assert rows.exceptAll(locked.unionByName(rejected)).count() == 0 and locked.count() + rejected.count() == 60_000
