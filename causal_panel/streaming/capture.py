"""Capture-time discipline: deadline gate, append-once, overlays and change detection.

Each rule is a batch function on DataFrames; the stream runners apply it to micro-batches with
checkpointed progress, so a restarted query carries on where it stopped.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import availability_overlay
from ..sources.scratch import settle
from ..sources.snapshots import capture_changes

# Fields no capture may hold (realised, and closing market).
REALISED_FIELDS = (
    "points", "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "bps", "full_time_home_goals", "full_time_away_goals",
)
CLOSING_FIELDS = ("B365CH", "B365CD", "B365CA", "AvgCH", "AvgCD", "AvgCA", "PSCH", "PSCD", "PSCA")


def deadline_gate(captures: DataFrame, deadlines: DataFrame, keys: Sequence[str], forbidden=REALISED_FIELDS + CLOSING_FIELDS) -> DataFrame:
    """Errors and eligibility of each capture against its deadline.

    captures: keys, captured_at, timing, fields (array), decision_status; deadlines: keys, deadline.
    Locked captures may be promoted, provisional ones only shadowed; an unknown time is never eligible.
    Works on a batch or a stream (stream-static join).
    """
    joined = captures.join(deadlines, list(keys), "left")
    before = F.coalesce(F.col("captured_at") <= F.col("deadline"), F.lit(False))
    exact = F.coalesce(F.col("timing") == "exact-capture", F.lit(False))
    found = F.array_sort(F.array_intersect("fields", F.array(*[F.lit(f) for f in sorted(set(forbidden))])))
    marks = [(F.size(found) > 0, "forbidden-field"), (exact & ~before, "captured-after-deadline")]
    errors = F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in marks]))
    clean = exact & before & (F.size(found) == 0)
    status = F.col("decision_status")
    return (
        joined.withColumn("forbidden_fields", found).withColumn("errors", errors)
        .withColumn("shadow_eligible", clean & F.coalesce(status.isin("provisional", "locked"), F.lit(False)))
        .withColumn("promotion_eligible", clean & F.coalesce(status == "locked", F.lit(False)))
    )


def refuse_late_lock(captures: DataFrame) -> DataFrame:
    """Rows that claim to be locked at or after their deadline."""
    return captures.where((F.col("decision_status") == "locked") & (F.col("captured_at") >= F.col("deadline")))


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything available in micro-batches, then stop."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_gate(stream: DataFrame, deadlines: DataFrame, keys: Sequence[str], accepted: str, quarantine: str, checkpoint: str) -> None:
    """Split a stream of captures into accepted rows and a quarantine of late or tainted ones.

    Each micro-batch writes its own folder, so a batch that is tried again replaces itself.
    """
    gated = deadline_gate(stream, deadlines, keys)

    def handle(batch: DataFrame, number: int) -> None:
        good = F.size("errors") == 0
        batch.where(good).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.where(~good).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    run_batches(gated, checkpoint, handle)


def run_lock_once(stream: DataFrame, keys: Sequence[str], order: Sequence[str], locked: str, rejected: str, checkpoint: str) -> None:
    """Lock the first decision per key; later ones, however late, are kept apart as rejected.

    Of a micro-batch the first by `order` (nulls last) is taken, unless an earlier batch has locked the key. The keys met so far are Spark's own
    deduplication state in the stream's checkpoint, so a micro-batch looks at its own keys, however many were locked before: beside its rows it
    brings one mark per key that is new. Each micro-batch writes its own folder, and state belongs to a batch, so a batch that is tried again
    replaces itself.
    """
    new = stream.select(*keys).dropDuplicates(list(keys)).select(
        *[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema], F.lit(True).alias("_new"))
    marked = stream.withColumn("_new", F.lit(False)).union(new)  # both sides read one source, so marks come with their rows

    def handle(batch: DataFrame, number: int) -> None:
        batch = settle(batch.withColumn("_row", F.monotonically_increasing_id()), "lock-batch")  # numbers are fixed by writing them
        place = F.struct("_new", *[c for o in order for c in (F.col(o).isNull(), F.col(o))], "_row")
        first = batch.groupBy(*keys).agg(F.min(place).alias("_first"), F.max("_new").alias("_free"))  # marks come after rows
        first = first.where("_free").select(F.col("_first._row").alias("_row"), F.lit(True).alias("_locked"))
        decided = settle(batch.where("not _new").join(first, "_row", "left").select(*stream.columns, F.col("_locked").isNotNull().alias("_locked")), "locked-batch")
        decided.where("_locked").drop("_locked").write.mode("overwrite").parquet(f"{locked}/batch={number}")
        decided.where("not _locked").drop("_locked").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    run_batches(marked, checkpoint, handle)


def lock_once_batch(decisions: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    others = [c for c in decisions.columns if c not in keys]
    first = F.min_by(F.struct(*others), order)
    return decisions.groupBy(*keys).agg(first.alias("_d"), (F.count(F.lit(1)) - 1).alias("rejected")).select(*keys, "_d.*", "rejected")


def overlay_status(projections: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Projections rescaled by the newest status chance; untouched where there is none.

    projections: key, previous_chance, probability, minutes, projected; latest: key, chance.
    """
    joined = projections.join(latest.select(key, "chance"), key, "left")
    known = F.col("chance").isNotNull()
    new = availability_overlay("chance", "previous_chance", "probability", "minutes", "projected")
    return joined.select(
        key, known.alias("updated"), *[F.when(known, new[c]).otherwise(F.col(c)).cast("double").alias(c) for c in ("probability", "minutes", "projected")]
    )


def latest_status(log: DataFrame, key: str, instant: str, values: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct(*values), F.col(instant))
    return log.groupBy(key).agg(last.alias("_l")).select(key, "_l.*")


def run_status_log(stream: DataFrame, key: str, instant: str, values: Sequence[str], path: str, checkpoint: str) -> None:
    """Keep the newest status per key of every micro-batch; read them back with `latest_status`."""

    def handle(batch: DataFrame, number: int) -> None:
        last = F.max_by(F.struct(*values), F.col(instant))
        batch.groupBy(key).agg(F.max(instant).alias(instant), last.alias("_l")).select(key, instant, "_l.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, checkpoint, handle)


def admit_overrides(overrides: DataFrame, captured: Column) -> DataFrame:
    """Mark each override valid when its ranges hold and its zoned instant is not in the future.

    overrides: minutes, start, confidence, updated_at (text with a zone).
    """
    zoned = F.coalesce(F.col("updated_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False))
    instant = F.try_to_timestamp("updated_at")
    confidence = F.coalesce(F.col("confidence"), F.lit(0.75))
    ranges = F.col("minutes").between(0, 90) & F.col("start").between(0, 1) & confidence.between(0, 1)
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(ranges, F.lit(False)), F.lit("range")), F.when(~zoned, F.lit("no-zone")),
        F.when(zoned & F.coalesce(instant > captured, F.lit(True)), F.lit("future")),
    ))
    return overrides.withColumn("confidence", confidence).withColumn("errors", errors).withColumn("admitted", F.size(errors) == 0)


def merge_overrides(model: DataFrame, admitted: DataFrame, key: str) -> DataFrame:
    """Confidence-weighted mix of override and model times official chance; `priority` marks late news.

    model: key, model_minutes, model_start, chance (0..100 or null), status, news (text or null). Of several admitted overrides
    of a key the latest counts.
    """
    given = F.struct(F.col("minutes").alias("_m"), F.col("start").alias("_s"), F.col("confidence").alias("_c"))
    latest = F.max_by(given, F.struct(F.try_to_timestamp("updated_at"), given))
    taken = admitted.where("admitted").groupBy(key).agg(latest.alias("_o")).select(key, "_o.*")
    joined = model.join(taken, key, "left")
    factor = F.least(F.greatest(F.coalesce(F.col("chance"), F.lit(100.0)) / 100.0, F.lit(0.0)), F.lit(1.0))
    official_minutes, official_start = F.col("model_minutes") * factor, F.col("model_start") * factor
    given = F.col("_c").isNotNull()
    minutes = F.when(given, F.col("_c") * F.col("_m") + (1 - F.col("_c")) * official_minutes).otherwise(official_minutes)
    start = F.when(given, F.col("_c") * F.col("_s") + (1 - F.col("_c")) * official_start).otherwise(official_start)
    gap = F.abs(minutes - F.col("model_minutes"))
    return joined.select(
        key, minutes.alias("expected_minutes"), start.alias("start_probability"), gap.alias("disagreement"),
        ((F.col("status") != "a") | (gap >= 12) | given | (F.trim(F.coalesce("news", F.lit(""))) != "")).alias("priority"),
    )


def run_change_log(stream: DataFrame, scope: Sequence[str], capture: str, columns: Sequence[str], path: str, checkpoint: str) -> None:
    """Store every micro-batch of a schedule stream; compare captures with `changes_of`."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.select(*scope, capture, *columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, checkpoint, handle)


def changes_of(log: DataFrame, scope: Sequence[str], capture: str, columns: Sequence[str]) -> DataFrame:
    return capture_changes(log, scope, capture, columns)
