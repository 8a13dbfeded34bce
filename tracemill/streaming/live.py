"""Event streams (an extension: the batch engine is complete without them)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.eventlog import SEPARATOR, EventLog
from ..sources.files import with_identity
from ..sources.store import Store

KEY = ["source_system", "source_event_id"]


def without_repeats(events: DataFrame, within: str = "1 hour", default_system: str = "api") -> DataFrame:
    """A stream's events, each identity once within a time of its first arrival.

    The time is that of arrival, so an event that occurred long ago is not dropped, and
    the state holds the identities of the last `within` only. What comes again
    later is left to the store. Events without an identity all pass.
    """
    known = with_identity(events, default_system).withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    named = known.where("source_event_id IS NOT NULL").dropDuplicatesWithinWatermark(KEY)
    return named.unionByName(known.where("source_event_id IS NULL")).drop("arrived_at")


def ingest_stream(events: DataFrame, store: Store, process_id: str, checkpoint: str, once: bool = True, within: str | None = "1 hour") -> StreamingQuery:
    """Insert a stream of canonical events batch by batch, each event once.

    within: for how long after its arrival a repeated event is dropped without a look at the
    store; None: never.
    """

    def insert(batch: DataFrame, _: int) -> None:
        rows = batch if "row_index" in batch.columns else batch.withColumn("row_index", F.monotonically_increasing_id())
        store.insert_events(rows.checkpoint(), process_id)  # the state is gone through once a batch

    if within is not None:
        events = without_repeats(events, within)
    writer = events.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark, which needs a timestamp with zone."""
    return events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)


def activity_rates(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per activity and window, with bounded state."""
    return _timed(events, late).groupBy(F.window("occurred_at", window), "activity").agg(F.count("*").alias("events"), F.count_if("is_manual").alias("manual"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each actor by the pause between events."""
    return _timed(events, late).groupBy(F.session_window("occurred_at", gap), "actor_id").agg(F.count("*").alias("events"))


# ------------------------------------------------------------------ open cases

#: What is kept of an event of an open case.
EVENT = "sid string, occ long, fin long, activity string, owner string, service long, is_manual boolean, money double"
OPEN_CASE = (
    "case_id string, state string, as_of timestamp, waited long, last_activity string, started long, ended long, event_count long, service long, throughput long, waiting long, "
    "handoff_count long, rework_count long, manual_event_count long, monetary_value double, variant_key string"
)


def measured(events: list[tuple]) -> dict:
    """A case's measures by its events (as of EVENT), as `EventLog.cases` has them."""
    events = sorted(events, key=lambda e: (e[1], e[3], e[0]))
    started, ended, service = min(e[1] for e in events), max(e[2] for e in events), sum(e[5] for e in events)
    throughput = max(ended - started, 0)
    names = [e[3] for e in events]
    money = [e[7] for e in events if e[7] is not None]
    return {
        "started": started, "ended": ended, "event_count": len(events), "service": service, "throughput": throughput, "waiting": max(throughput - service, 0),
        "handoff_count": sum(a[4] != b[4] for a, b in zip(events, events[1:])), "rework_count": len(names) - len(set(names)), "manual_event_count": sum(bool(e[6]) for e in events),
        "monetary_value": max(money) if money else None, "variant_key": hashlib.sha1(SEPARATOR.join(names).encode()).hexdigest()[:16], "last_activity": names[-1],
    }


class OpenCases(StatefulProcessor):
    """State of a case: its events. A timer stands at the end of its last one, after `stalled`, then after `closed`."""

    def __init__(self, stalled: timedelta, closed: timedelta) -> None:
        self.stalled, self.closed = (int(t.total_seconds() * 1000) for t in (stalled, closed))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)

    def _held(self) -> list[tuple]:
        return [tuple(e) for e in self.events.get()] if self.events.exists() else []

    def _row(self, key: tuple, state: str, events: list[tuple], now: int) -> Row:
        case = measured(events)
        known = {"case_id": key[0], "state": state, "as_of": datetime.fromtimestamp(now / 1000), "waited": max(now * 1000 - case["ended"], 0)} | case
        return Row(**{name: known[name] for name in (c.split()[0] for c in OPEN_CASE.split(", "))})

    def _timers(self, ended: int, now: int) -> None:
        """Timers at the end of the case's last event, after what makes it stalled and closed, if that is still to come."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for after in (self.stalled, self.closed):
            self.handle.registerTimer(max(ended // 1000 + after, now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        known = {e[0] for e in held}
        new = []
        for r in rows:
            if r.sid not in known:
                known.add(r.sid)
                new.append((r.sid, r.occ, r.fin, r.activity, r.owner, r.service, r.is_manual, r.money))
        if not new:
            return
        self.events.appendList(new)
        now = timerValues.getCurrentWatermarkInMs()
        self._timers(max(e[2] for e in [*held, *new]), now)
        yield self._row(key, "open", [*held, *new], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        if not held:
            return
        over = now - max(e[2] for e in held) // 1000 >= self.closed
        yield self._row(key, "closed" if over else "stalled", held, now)
        if over:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.events.clear()

    def close(self) -> None:
        pass


def open_cases(events: DataFrame, stalled: timedelta = timedelta(hours=8), closed: timedelta = timedelta(days=7), late: str = "1 day") -> DataFrame:
    """A stream of the present state of cases: a row when events of a case come, when it stalls and when it closes.

    state: open, stalled (no event for so long) or closed; waited: microseconds from the
    end of its last event to `as_of`, which is the watermark. A closed row has the measures that
    `EventLog.cases` gives for the case. Events may come in any order and repeatedly;
    those that occurred more than `late` before the latest are dropped, and an event of a
    closed case begins another. The state is the events of the cases that are not closed.
    """
    rows = EventLog(_timed(with_identity(events), late)).timed()
    sid = F.coalesce("source_event_id", F.concat_ws(":", "activity", F.col("occ").cast("string")))
    rows = rows.select("case_id", "occurred_at", sid.alias("sid"), "occ", "fin", "activity", "owner", "service", "is_manual", F.col("monetary_value").alias("money"))
    return rows.groupBy("case_id").transformWithState(OpenCases(stalled, closed), OPEN_CASE, "Update", "EventTime")


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A stream's result as an in-memory table, for tests."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
