"""Events that must be acknowledged in time, and runs that must give signs of life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.clocks import seconds_between
from tidegauge.operators.units import latest

TIMEOUT_S, STALE_S = 120, 30
ALIVE = ("running", "waiting_resources", "stopping")


def event_id(payload: DataFrame, columns: list[str] | None = None) -> Column:
    """sha256 of the payload's columns as JSON, in the order of their names."""
    names = sorted(columns or payload.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in names]), {"ignoreNullFields": "false"}), 256)


def published_once(payload: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds event_id; equal payloads are one event."""
    return payload.withColumn("event_id", event_id(payload, columns)).dropDuplicates(["event_id"])


def pending(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    return outbox.join(acks.select("event_id"), "event_id", "left_anti")


def registered_only(runs: DataFrame, registrations: DataFrame) -> DataFrame:
    return runs.join(registrations.select("run_id"), "run_id", "left_semi")


def acknowledgment_due(queued: Column, timeout_s: Column) -> Column:
    """Null unless the timeout is a positive whole number of seconds."""
    return F.when(timeout_s > 0, queued + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), timeout_s.cast("decimal(18,6)")))


def first_acks(acks: DataFrame) -> DataFrame:
    """The first acknowledgment of each event; later ones are repeats."""
    others = [c for c in acks.columns if c not in ("event_id", "acknowledged_at")]
    top = acks.groupBy("event_id").agg(F.min(F.struct("acknowledged_at", *others)).alias("_first"), F.count("*").alias("_n"))
    return top.select("event_id", F.col("_first.acknowledged_at").alias("acknowledged_at"), *[F.col(f"_first.{c}").alias(c) for c in others], (F.col("_n") - 1).alias("already_consumed"))


def delivery_health(events: DataFrame, receipts: DataFrame, acks: DataFrame, now, claims: DataFrame | None = None, timeout_s: int = TIMEOUT_S) -> DataFrame:
    """Where each event (event_id) stands at ``now``, and what is wrong with its evidence.

    ``receipts``: (event_id, target, queued_at, ...), perhaps with status, ack_timeout_s,
    ack_due_at, receipt_sha256.  ``acks``: (event_id, acknowledged_at, ...), perhaps with
    thread_id, consumed_by_owner, queue_receipt_sha256.  Clocks are timestamps.  A late
    acknowledgment stays late; an error has no status.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    has = lambda df, c, default: F.col(c) if c in df.columns else default
    own = receipts.select("event_id", "target", "queued_at", has(receipts, "status", F.lit("queued")).alias("receipt_status"), F.coalesce(has(receipts, "ack_timeout_s", F.lit(timeout_s)), F.lit(timeout_s)).alias("timeout"), has(receipts, "ack_due_at", F.lit(None).cast("timestamp")).alias("stated_due"), has(receipts, "receipt_sha256", F.lit(None).cast("string")).alias("receipt_sha256"), F.lit(True).alias("has_receipt"))
    first = first_acks(acks)
    got = first.select("event_id", "acknowledged_at", "already_consumed", has(acks, "thread_id", F.lit(None).cast("string")).alias("thread_id"), has(acks, "consumed_by_owner", F.lit(True)).alias("owned"), has(acks, "queue_receipt_sha256", F.lit(None).cast("string")).alias("ack_sha256"), F.lit(True).alias("has_ack"))
    claimed = (claims if claims is not None else receipts).select("event_id").distinct().withColumn("claimed", F.lit(True))
    df = events.select("event_id").distinct().join(own, "event_id", "left").join(got, "event_id", "left").join(claimed, "event_id", "left")
    df = df.withColumn("due", acknowledgment_due(F.col("queued_at"), F.col("timeout")))
    receipt, ack = F.coalesce("has_receipt", F.lit(False)), F.coalesce("has_ack", F.lit(False))
    mismatch = (F.col("thread_id").isNotNull() & (F.col("thread_id") != F.col("target"))) | ~F.coalesce("owned", F.lit(False)) | (F.col("receipt_sha256").isNotNull() & ~F.col("receipt_sha256").eqNullSafe(F.col("ack_sha256")))
    error = (
        F.when(~receipt, None).when(F.col("receipt_status") != "queued", "invalid_queue_receipt").when(F.col("queued_at").isNull(), "invalid_delivery_timestamp").when(F.col("due").isNull(), "delivery_ack_timeout_requires_positive_integer")
        .when(F.col("stated_due").isNotNull() & (F.col("stated_due") != F.col("due")), "delivery_deadline_mismatch").when(now < F.col("queued_at"), "delivery_clock_regression")
        .when(ack & mismatch, "delivery_ack_receipt_mismatch").when(ack & (F.col("acknowledged_at").isNull() | (F.col("acknowledged_at") < F.col("queued_at")) | (F.col("acknowledged_at") > now)), "delivery_ack_clock_invalid")
    )
    late = F.col("acknowledged_at") > F.col("due")
    status = F.when(~receipt, F.when(F.col("claimed"), "submission_uncertain").otherwise("not_submitted")).when(ack, F.when(late, "acknowledged_late").otherwise("acknowledged")).when(now > F.col("due"), "acknowledgment_overdue").otherwise("awaiting_ack")
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    return df.select(
        "event_id", "target", F.when(ok, status).alias("status"), "queued_at", "due", F.when(ok & receipt, seconds_between("queued_at", now)).alias("elapsed_s"),
        F.when(ok & ack, seconds_between("queued_at", "acknowledged_at")).alias("queued_to_ack_s"), F.when(ok & ack, ~late).alias("within_slo"), F.coalesce("already_consumed", F.lit(0)).alias("repeats"), "error",
    )


def heartbeat_health(heartbeats: DataFrame, now, stale_s: float = STALE_S) -> DataFrame:
    """Latest heartbeat (run_id, status, heartbeat_at) of each run; an active run that has
    been silent for longer than ``stale_s`` is at risk."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    last = latest(heartbeats.select("run_id", "status", "heartbeat_at"), ("run_id",), "heartbeat_at")
    age = seconds_between("heartbeat_at", now)
    risk = F.col("status").isin(*ALIVE) & (age > stale_s)
    return last.select("run_id", F.when(risk, "at_risk").otherwise(F.col("status")).alias("status"), "heartbeat_at", age.alias("heartbeat_age_s"), F.when(risk, "controller_heartbeat_stale").alias("blocker"))


def watchdog(registrations: DataFrame, states: DataFrame, heartbeats: DataFrame, health: DataFrame, now, paused: DataFrame | None = None) -> DataFrame:
    """One row for each registered run, with its first blocker or none.

    ``states``: (run_id, status, blocker); ``health``: delivery_health with run_id.  A
    pause suppresses alerts.  Runs are rows of joins, so a bad one hides no other.
    """
    stopped = (paused if paused is not None else registrations.limit(0)).select("run_id").distinct().withColumn("paused", F.lit(True))
    beats = heartbeat_health(heartbeats, now).select("run_id", F.col("blocker").alias("silent"))
    late = health.groupBy("run_id").agg(F.bool_or(F.col("error").isNotNull()).alias("invalid"), F.bool_or(F.coalesce(F.col("status") == "acknowledgment_overdue", F.lit(False))).alias("overdue"))
    df = registrations.select("run_id").distinct().join(states.select("run_id", F.col("status").alias("state"), F.col("blocker").alias("own")), "run_id", "left").join(beats, "run_id", "left").join(late, "run_id", "left").join(stopped, "run_id", "left")
    halted = F.coalesce("paused", F.lit(False)) | F.coalesce(F.col("state").startswith("paused"), F.lit(False))
    blocker = F.when(~halted, F.coalesce(F.when(F.col("state").isNull(), "dispatch_state_missing"), "own", F.when(F.col("state") == "running", F.col("silent")), F.when(F.col("overdue"), "delivery_acknowledgment_overdue"), F.when(F.col("invalid"), "invalid_delivery_evidence")))
    df = df.withColumn("blocker", blocker)
    return df.select("run_id", F.when(halted, "paused").when(F.col("blocker").isNotNull(), "at_risk").otherwise(F.col("state")).alias("status"), "blocker")


def watchdog_summary(rows: DataFrame) -> DataFrame:
    found = rows.agg(F.count("*").alias("runs"), F.count("blocker").alias("attention_count"))
    return found.withColumn("status", F.when(F.col("attention_count") > 0, "at_risk").when(F.col("runs") > 0, "observed_no_blocker").otherwise("no_registered_dispatches"))
