"""The workflow as keyed state of a stream, with event-time timers that escalate what stays too long."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.workflow import AUTO_LIMITS, TRANSITIONS
from ledgerloom.streaming.jobs import run_batches

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "state string, since long, applied int, invalid int, timed int"
OUT = "record long, state string, since long, applied int, invalid int, timed int"
RULES = {(s, a, r): n for s, a, n, roles in TRANSITIONS for r in roles.split(",")}


class Workflow(StatefulProcessor):
    """Per record its state, since when (microseconds) and its counts; a timer stands where the state's time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("workflow", STATE)

    def due(self, state: str, since: int) -> int | None:
        return since + AUTO_LIMITS[state] * 60_000_000 if state in AUTO_LIMITS else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted((r.at, r.seq, r.action, r.role) for r in rows)
        known = self.value.get()  # None for a new record
        state, since, applied, invalid, timed = known or ("draft", events[0][0], 0, 0, 0)
        stands = self.due(state, since) if known else None
        for at, _, action, role in events:
            due = self.due(state, since)
            if due is not None and due < at:
                state, since, timed = "escalated", due, timed + 1
            new = RULES.get((state, action, role))
            if new is None:
                invalid += 1
            else:
                state, since, applied = new, at, applied + 1
        self.value.update((state, since, applied, invalid, timed))
        # The state says which timer stands: each call is a trip to the JVM, so none is asked for and only another one is set.
        if (due := self.due(state, since)) != stands:
            if stands is not None:
                self.handle.deleteTimer(stands // 1000 + 1)
            if due is not None:
                self.handle.registerTimer(due // 1000 + 1)
        yield Row(record=key[0], state=state, since=since, applied=applied, invalid=invalid, timed=timed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, since, applied, invalid, timed = self.value.get()
        due = self.due(state, since)
        if due is not None and due < timerValues.getCurrentWatermarkInMs() * 1000:
            state, since, timed = "escalated", due, timed + 1
            self.value.update((state, since, applied, invalid, timed))
            yield Row(record=key[0], state=state, since=since, applied=applied, invalid=invalid, timed=timed)

    def close(self) -> None:
        pass


def stateful_workflow(log: DataFrame, path: str, delay: str = "1 hour") -> DataFrame:
    """The last state of each record of a stream of events (record, seq, action, role, ts), as of the watermark.

    State is kept in RocksDB on the executors and checkpointed under path, so it may outgrow memory and outlives a lost
    executor; a record's state is five numbers, however long its log. Every batch's changes are written under its
    own id, and the last one of a record holds. Events later than `delay` are dropped by the watermark. Equal to replay_timed over
    the same log with as_of at the last watermark.
    """
    spark = log.sparkSession
    events = log.withWatermark("ts", delay).select("record", F.unix_micros("ts").alias("at"), "seq", "action", "role", "ts")
    changes = events.groupBy("record").transformWithState(Workflow(), OUT, "Update", "EventTime")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        found = run_batches(changes, path, mode="update")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    last = found.groupBy("record").agg(F.max_by(F.struct("state", "since", "applied", "invalid", "timed"), F.struct("batch", "timed")).alias("x"))
    return last.select("record", "x.state", F.timestamp_micros("x.since").alias("since"), "x.applied", "x.invalid", "x.timed")
