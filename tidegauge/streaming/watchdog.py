"""The watchdog as a stateful stream: an alert whenever a run's verdict changes.

Each run's state is a row of its own and its open deliveries; timers call it when a
deadline or the silence of its controller comes due, so nothing is polled and no
past event is read again.  Verdicts are those of ``operators.events.watchdog`` at the
watermark, in whole milliseconds.  The session needs the RocksDB state store, as all
``transformWithState`` does.

What leaves the state: a delivery once the watermark has passed its acknowledgment (an
invalid one stays in a count), an acknowledgment without a receipt once the watermark
has passed it.  What is not acknowledged stays, as it may still be, late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.operators.events import ALIVE, STALE_S, TIMEOUT_S

EVENT = "run_id string, kind string, at timestamp, at_ms long, status string, blocker string, event_id string, target string, timeout_s long"
ALERT = "run_id string, status string, blocker string, at_ms long"


def watchdog_events(
    registrations: DataFrame, states: DataFrame, heartbeats: DataFrame, receipts: DataFrame, acks: DataFrame, pauses: DataFrame | None = None, timeout_s: int = TIMEOUT_S
) -> DataFrame:
    """One stream of all that a run's verdict depends on.

    Each has run_id and its clock: registered_at; at, with status and blocker; heartbeat_at,
    with status; queued_at, with event_id and target; acknowledged_at, with event_id and perhaps
    thread_id; at, with paused.
    """
    kinds = [
        ("registration", registrations, "registered_at", {}), ("state", states, "at", {"status": F.col("status"), "blocker": F.col("blocker")}), ("heartbeat", heartbeats, "heartbeat_at", {"status": F.col("status")}),
        ("receipt", receipts, "queued_at", {"event_id": F.col("event_id"), "target": F.col("target"), "timeout_s": F.coalesce(F.col("ack_timeout_s"), F.lit(timeout_s)) if "ack_timeout_s" in receipts.columns else F.lit(timeout_s)}),
        ("ack", acks, "acknowledged_at", {"event_id": F.col("event_id"), "target": F.col("thread_id") if "thread_id" in acks.columns else F.lit(None)}),
    ]
    if pauses is not None:
        kinds.append(("pause", pauses, "at", {"status": F.when(F.col("paused"), "paused")}))
    every = None
    for kind, df, clock, more in kinds:
        given: dict[str, Column] = {"kind": F.lit(kind), "run_id": F.col("run_id").cast("string"), "at": F.col(clock), "at_ms": F.unix_millis(clock), **more}
        one = df.select(*[given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in (f.split() for f in EVENT.split(", "))])
        every = one if every is None else every.unionByName(one)
    return every


class Watchdog(StatefulProcessor):
    """Follows one run.  A run: whether registered and paused, its state, last heartbeat, how
    many deliveries are overdue or invalid, and what was last told."""

    RUN = "registered boolean, paused boolean, paused_at long, state string, own string, state_at long, beat string, beat_at long, overdue long, invalid long, told string, told_blocker string"
    DELIVERY = "queued_at long, due long, target string, ack_at long, thread string, overdue boolean"

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", self.RUN)
        self.deliveries = handle.getMapState("deliveries", "event_id string", self.DELIVERY)
        #: Deliveries to look at when the watermark passes a time.
        self.calls = handle.getMapState("calls", "at long", "events array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run = self._load()
        for r in sorted(rows, key=lambda r: (r.at_ms, r.kind)):
            if r.kind == "registration":
                run["registered"] = True
            elif r.kind == "pause" and r.at_ms >= run["paused_at"]:
                run.update(paused=r.status is not None, paused_at=r.at_ms)
            elif r.kind == "state" and r.at_ms >= run["state_at"]:
                run.update(state=r.status, own=r.blocker, state_at=r.at_ms)
            elif r.kind == "heartbeat" and r.at_ms >= run["beat_at"]:
                run.update(beat=r.status, beat_at=r.at_ms)
                self._call(r.at_ms + self.stale_ms + 1, None)
            elif r.kind in ("receipt", "ack"):
                self._delivery(run, r, timerValues.getCurrentWatermarkInMs())
        yield from self._told(key, run, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run, now, at = self._load(), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if called := self.calls.getValue((at,)):
            self.calls.removeKey((at,))
            for event in called[0]:
                self._settle(run, event, now)
        yield from self._told(key, run, now)

    def _load(self) -> dict:
        names = [f.split()[0] for f in self.RUN.split(", ")]
        blank = dict.fromkeys(names) | {"registered": False, "paused": False, "paused_at": -1, "state_at": -1, "beat_at": -1, "overdue": 0, "invalid": 0}
        return dict(zip(names, self.run.get(), strict=True)) if self.run.exists() else blank

    def _call(self, at: int, event: str | None) -> None:
        if event is not None:
            waiting = self.calls.getValue((at,))
            self.calls.updateValue((at,), ([*(waiting[0] if waiting else []), event],))
        self.handle.registerTimer(at)

    def _delivery(self, run: dict, r: Row, now: int) -> None:
        held = self.deliveries.getValue((r.event_id,)) or (None, None, None, None, None, False)
        queued, due, target, ack, thread, overdue = held
        if r.kind == "receipt" and queued is None:
            queued, due, target = r.at_ms, r.at_ms + 1000 * r.timeout_s, r.target
            self._call(due + 1, r.event_id)
        elif r.kind == "ack" and (ack is None or r.at_ms < ack):
            ack, thread = r.at_ms, r.target
        if ack is not None:
            # Until the watermark has passed both, an earlier acknowledgment may come.
            self._call(max(ack, queued or 0) + 1, r.event_id)
        self.deliveries.updateValue((r.event_id,), (queued, due, target, ack, thread, overdue))
        self._settle(run, r.event_id, now)

    def _settle(self, run: dict, event: str, now: int) -> None:
        """What a delivery adds to its run at the watermark, and whether it is done with."""
        held = self.deliveries.getValue((event,))
        if not held:
            return
        queued, due, target, ack, thread, was = held
        if queued is None:
            if ack < now:
                self.deliveries.removeKey((event,))
            return
        overdue = ack is None and now > due
        run["overdue"] += int(overdue) - int(was)
        if ack is not None and max(ack, queued) < now:
            run["invalid"] += int(ack < queued or (thread is not None and thread != target))
            self.deliveries.removeKey((event,))
        elif overdue != was:
            self.deliveries.updateValue((event,), (queued, due, target, ack, thread, overdue))

    def _told(self, key: tuple, run: dict, now: int) -> Iterator[Row]:
        state, silent = run["state"], run["beat"] in ALIVE and now - run["beat_at"] > self.stale_ms
        if run["paused"] or (state or "").startswith("paused"):
            status, blocker = "paused", None
        else:
            blocker = "dispatch_state_missing" if state is None else run["own"]
            blocker = blocker or ("controller_heartbeat_stale" if state == "running" and silent else None)
            blocker = blocker or ("delivery_acknowledgment_overdue" if run["overdue"] else "invalid_delivery_evidence" if run["invalid"] else None)
            status = "at_risk" if blocker else state
        if run["registered"] and (status, blocker) != (run["told"], run["told_blocker"]):
            run.update(told=status, told_blocker=blocker)
            yield Row(run_id=key[0], status=status, blocker=blocker, at_ms=now)
        self.run.update(tuple(run.values()))


def watchdog(events: DataFrame, lateness: str = "10 seconds", stale_s: int = STALE_S) -> DataFrame:
    """run_id, status, blocker and at (the watermark) of each change of a registered run's
    verdict; ``events``: as ``watchdog_events`` gives them."""
    keyed = events.withWatermark("at", lateness).groupBy("run_id")
    told = keyed.transformWithState(Watchdog(1000 * stale_s), ALERT, "Append", "EventTime")
    return told.select("run_id", "status", "blocker", F.timestamp_millis("at_ms").alias("at"))
