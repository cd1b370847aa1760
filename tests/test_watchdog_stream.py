"""The stateful watchdog against its batch twin, with a restart in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import events
from tidegauge.streaming import watchdog

T0 = dt.datetime(2026, 8, 1, 10, 0, 0)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TABLES = {
    "registrations": "run_id string, registered_at timestamp", "states": "run_id string, at timestamp, status string, blocker string", "heartbeats": "run_id string, heartbeat_at timestamp, status string",
    "receipts": "run_id string, event_id string, target string, queued_at timestamp", "acks": "run_id string, event_id string, acknowledged_at timestamp, thread_id string", "pauses": "run_id string, at timestamp, paused boolean",
}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write(spark, root, rows):
    """Appends rows by table, each file with what happened in its stretch."""
    for name, schema in TABLES.items():
        mine = [r for kind, *r in rows if kind == name]
        if mine:
            spark.createDataFrame([tuple(r) for r in mine], schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def drain(spark, root, out):
    streams = {n: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{root}/{n}") for n, s in TABLES.items()}
    told = watchdog.watchdog(watchdog.watchdog_events(**streams))
    query = told.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    return spark.read.parquet(f"{out}/rows")


def batch(spark, root, now):
    """The batch twin over all that has happened."""
    held = {n: spark.read.schema(s).parquet(f"{root}/{n}") for n, s in TABLES.items()}
    last = lambda df, clock: df.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != clock]), clock).alias("x")).select("x.*")
    health = events.delivery_health(held["receipts"], held["receipts"], held["acks"].drop("run_id"), now).join(held["receipts"].select("event_id", "run_id"), "event_id")
    paused = last(held["pauses"], "at").where("paused")
    rows = events.watchdog(held["registrations"], last(held["states"], "at"), held["heartbeats"], health, now, paused)
    return {r.run_id: (r.status, r.blocker) for r in rows.collect()}


def story():
    """What happens to some runs; all of them end before 1000 s."""
    rows = [("registrations", r, at(0)) for r in ("well", "silent", "overdue", "late", "early", "wrong", "failed", "missing", "halted", "resumed", "orphan")]
    rows += [("states", r, at(1), "running", None) for r in ("well", "silent", "overdue", "late", "early", "wrong", "halted", "resumed", "orphan", "stranger")]
    rows += [("states", "failed", at(2), "dispatch_failed", "dispatch_failed:x")]
    rows += [("heartbeats", r, at(t), "running") for r in ("well", "overdue", "late", "early", "wrong", "halted", "resumed", "orphan") for t in range(5, 1000, 25)]
    rows += [("heartbeats", r, at(10), "running") for r in ("silent", "stranger")]
    rows += [("receipts", r, f"{r}-1", "t", at(20)) for r in ("well", "overdue", "late", "early", "wrong", "halted", "resumed")]
    rows += [("acks", "well", "well-1", at(60), "t"), ("acks", "late", "late-1", at(400), "t"), ("acks", "early", "early-1", at(15), "t"), ("acks", "wrong", "wrong-1", at(30), "other"), ("acks", "orphan", "none", at(40), "t"), ("acks", "well", "well-1", at(90), "t")]
    rows += [("pauses", "halted", at(50), True), ("pauses", "resumed", at(50), True), ("pauses", "resumed", at(500), False)]
    r = random.Random(5)
    for k in range(12):
        run = f"many{k}"
        rows += [("registrations", run, at(0)), ("states", run, at(0), "running", None), *[("heartbeats", run, at(t), "running") for t in range(0, 1000, 29)]]
        for j in range(r.randint(1, 5)):
            queued = r.randint(0, 700)
            rows.append(("receipts", run, f"{run}-{j}", "t", at(queued)))
            if r.random() < 0.8:
                rows.append(("acks", run, f"{run}-{j}", at(queued + r.choice([1, 60, 120, 121, 200])), "t"))
    return rows


def test_stream_tells_what_the_batch_twin_does(spark, rocks, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    clock = {"registrations": 2, "states": 2, "heartbeats": 2, "receipts": 4, "acks": 3, "pauses": 2}
    rows = story()
    when = lambda r: r[clock[r[0]]]
    # A run that is not looked at keeps the clock going in every table.
    ticks = lambda t: [("registrations", "clock", at(t)), ("states", "clock", at(t), "idle", None), ("heartbeats", "clock", at(t), "done"), ("receipts", "clock", f"c{t}", "t", at(t)), ("acks", "clock", f"c{t}", at(t), "t"), ("pauses", "clock", at(t), False)]
    told = {}
    for until in (200, 450, 1010):
        now = [r for r in rows if when(r) < at(until)]
        rows = [r for r in rows if when(r) >= at(until)]
        write(spark, root, now)
        write(spark, root, ticks(until))
        write(spark, root, ticks(until + 0.5))
        found = drain(spark, root, out)  # each time anew from the checkpoint
        told = {r.run_id: (r.x.status, r.x.blocker) for r in found.groupBy("run_id").agg(F.max_by(F.struct("status", "blocker"), "at").alias("x")).collect()}
        want = batch(spark, root, at(until + 0.5 - 10))
        assert {k: v for k, v in told.items() if k != "clock"} == {k: v for k, v in want.items() if k != "clock"}
    changes = {}
    for r in found.orderBy("at").collect():
        changes.setdefault(r.run_id, []).append(r.blocker)
    assert changes["well"] == [None] and changes["late"] == [None, "delivery_acknowledgment_overdue", None] and changes["halted"][-1] is None
    assert changes["silent"][-1] == "controller_heartbeat_stale" and changes["missing"] == ["dispatch_state_missing"] and "stranger" not in changes
    assert changes["resumed"][-1] == "delivery_acknowledgment_overdue" and changes["early"][-1] == changes["wrong"][-1] == "invalid_delivery_evidence"
    assert all(a != b for c in changes.values() for a, b in zip(c, c[1:], strict=False))
