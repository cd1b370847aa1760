"""Streaming twins of the event operators: deadlines and heartbeats on streams.

State is bounded by watermarks.  A deadline that the watermark has passed is reported
once and never taken back; late acknowledgments stay in their table, where the batch
operator labels them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.events import ALIVE, STALE_S, TIMEOUT_S, event_id


def published_once(payload: DataFrame, clock: str, lateness: str = "10 minutes") -> DataFrame:
    """Adds event_id and drops repeats that come within the watermark."""
    return payload.withColumn("event_id", event_id(payload)).withWatermark(clock, lateness).dropDuplicatesWithinWatermark(["event_id"])


def first_acks(acks: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return acks.withWatermark("acknowledged_at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def deadlines(receipts: DataFrame, acks: DataFrame, timeout_s: int = TIMEOUT_S, lateness: str = "10 seconds") -> DataFrame:
    """Receipts (event_id, queued_at) with the acknowledgment that came in time, or as
    overdue once the watermark passes the deadline."""
    queued = receipts.withWatermark("queued_at", lateness).select("event_id", "queued_at")
    got = acks.withWatermark("acknowledged_at", lateness).select(F.col("event_id").alias("ack_event_id"), "acknowledged_at")
    within = (F.col("event_id") == F.col("ack_event_id")) & (F.col("acknowledged_at") >= F.col("queued_at")) & (F.col("acknowledged_at") <= F.col("queued_at") + F.expr(f"interval {timeout_s} seconds"))
    joined = queued.join(got, within, "left_outer")
    return joined.select("event_id", "queued_at", "acknowledged_at", F.when(F.col("acknowledged_at").isNull(), "acknowledgment_overdue").otherwise("acknowledged").alias("status"))


def silent_runs(heartbeats: DataFrame, stale_s: int = STALE_S, lateness: str = "10 seconds") -> DataFrame:
    """Spans of heartbeats of active runs that ended in silence: a session that the
    watermark closed was followed by a gap of at least ``stale_s``."""
    sessions = heartbeats.withWatermark("heartbeat_at", lateness).groupBy("run_id", F.session_window("heartbeat_at", f"{stale_s} seconds").alias("span")).agg(F.max_by("status", "heartbeat_at").alias("status"), F.max("heartbeat_at").alias("heartbeat_at"))
    return sessions.where(F.col("status").isin(*ALIVE)).select("run_id", "status", "heartbeat_at", F.lit("controller_heartbeat_stale").alias("blocker"))
