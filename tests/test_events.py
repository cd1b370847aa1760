import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import events
from tidegauge.streaming import events as streams

T0 = dt.datetime(2026, 8, 1, 10, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frames(spark, acks=(), now=at(0), **more):
    receipts = spark.createDataFrame([("e1", "t", T0), ("e2", "t", T0)], "event_id string, target string, queued_at timestamp")
    ev = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "event_id string")
    a = spark.createDataFrame(list(acks), "event_id string, acknowledged_at timestamp, thread_id string")
    return {r.event_id: r for r in events.delivery_health(ev, receipts, a, now, **more).collect()}


def test_deadlines(spark):
    assert frames(spark, now=at(120))["e1"].status == "awaiting_ack"
    assert frames(spark, now=at(120) + dt.timedelta(microseconds=1))["e1"].status == "acknowledgment_overdue"
    late = frames(spark, [("e1", at(121), "t"), ("e1", at(130), "t"), ("e2", at(60), "t")], at(500))
    assert late["e1"].status == "acknowledged_late" and not late["e1"].within_slo and late["e1"].repeats == 1 and late["e1"].queued_to_ack_s == 121
    assert late["e2"].status == "acknowledged" and late["e2"].within_slo and late["e3"].status == "not_submitted"


@pytest.mark.parametrize("ack, now, error", [(("e1", at(-1), "t"), at(50), "delivery_ack_clock_invalid"), (("e1", at(60), "t"), at(50), "delivery_ack_clock_invalid"), (("e1", at(10), "other"), at(50), "delivery_ack_receipt_mismatch"), (None, at(-5), "delivery_clock_regression")])
def test_bad_evidence(spark, ack, now, error):
    row = frames(spark, [ack] if ack else [], now)["e1"]
    assert row.error == error and row.status is None


def test_stated_deadlines(spark):
    ev = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    receipts = spark.createDataFrame([("e1", "t", T0, 0, None), ("e2", "t", T0, 120, at(121))], "event_id string, target string, queued_at timestamp, ack_timeout_s int, ack_due_at timestamp")
    acks = spark.createDataFrame([], "event_id string, acknowledged_at timestamp")
    assert {r.event_id: r.error for r in events.delivery_health(ev, receipts, acks, at(1)).collect()} == {"e1": "delivery_ack_timeout_requires_positive_integer", "e2": "delivery_deadline_mismatch"}


def test_heartbeats_and_watchdog(spark):
    beats = spark.createDataFrame([("a", "running", at(0)), ("a", "running", at(60)), ("b", "running", at(10)), ("c", "succeeded", at(0)), ("z", "running", at(0))], "run_id string, status string, heartbeat_at timestamp")
    got = {r.run_id: r.status for r in events.heartbeat_health(beats, at(90)).collect()}
    assert got == {"a": "running", "b": "at_risk", "c": "succeeded", "z": "at_risk"}
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("p",)], "run_id string")
    states = spark.createDataFrame([("a", "running", None), ("b", "running", None), ("c", "dispatch_failed", "dispatch_failed:x"), ("p", "running", "x"), ("z", "failed", "y")], "run_id string, status string, blocker string")
    health = spark.createDataFrame([("a", "acknowledgment_overdue", None), ("b", None, "delivery_clock_regression")], "run_id string, status string, error string")
    rows = events.watchdog(runs, states, beats, health, at(90), spark.createDataFrame([("p",)], "run_id string"))
    assert {r.run_id: r.blocker for r in rows.collect()} == {"a": "delivery_acknowledgment_overdue", "b": "controller_heartbeat_stale", "c": "dispatch_failed:x", "d": "dispatch_state_missing", "p": None}
    assert events.watchdog_summary(rows).first().status == "at_risk" and events.watchdog_summary(rows.limit(0)).first().status == "no_registered_dispatches"
    assert events.registered_only(beats, runs).where("run_id = 'z'").count() == 0


def test_identity(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    once = events.published_once(df)
    assert once.count() == 2 and {r[0] for r in once.select(F.length("event_id")).collect()} == {64}
    assert events.published_once(df.select("b", "a")).select("event_id").exceptAll(once.select("event_id")).count() == 0
    acks = spark.createDataFrame([("k", at(0))], "event_id string, acknowledged_at timestamp")
    assert events.pending(spark.createDataFrame([("k",), ("l",)], "event_id string"), acks).count() == 1


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream(spark, rows, schema, path):
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streams_agree_with_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    queued = stream(spark, [("e1", at(0)), ("e2", at(1)), ("late", at(5000)), ("end", at(9000))], "event_id string, queued_at timestamp", tmp_path / "q")
    acked = stream(spark, [("e1", at(60)), ("end", at(9001)), ("x", at(9500)), ("y", at(9900))], "event_id string, acknowledged_at timestamp", tmp_path / "a")
    got = {r.event_id: r.status for r in drain(spark, streams.deadlines(queued, acked), "deadlines", tmp_path)}
    assert got["e1"] == "acknowledged" and got["e2"] == "acknowledgment_overdue"
    beats = stream(spark, [("r", "running", at(0)), ("r", "running", at(20)), ("r", "succeeded", at(300)), ("s", "running", at(900)), ("s", "running", at(2000))], "run_id string, status string, heartbeat_at timestamp", tmp_path / "h")
    silent = {(r.run_id, r.heartbeat_at) for r in drain(spark, streams.silent_runs(beats), "silent", tmp_path)}
    assert ("r", at(20)) in silent and ("s", at(900)) in silent and not any(r == "r" and t == at(300) for r, t in silent)
    payload = stream(spark, [("x", at(0)), ("x", at(0)), ("y", at(1))], "body string, sent_at timestamp", tmp_path / "p")
    assert len(drain(spark, streams.published_once(payload, "sent_at"), "once", tmp_path)) == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")
