"""Decisions on a stream as its events come: each event is told the running value of its key and whether it is within a limit.

The batch forms are `windows.counter` and `windows.sessions`; here a key's counter is a value of the state store, updated event by event, so the verdict
is there as soon as the micro-batch is. A counter starts anew when the window changes; a session when its idle time has passed. Timers of
event time remove the state of windows and sessions that are over, so the store holds live keys only.

A micro-batch's events of a key are sorted by time and tie before they count; events later than the watermark are dropped, as
Spark does. A null key is a key; null amounts are 0. The state store must be one with timers, which `stateful` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE = "1 hour"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful(spark: SparkSession) -> None:
    """Choose the state store that value states and timers need."""
    spark.conf.set(*_STORE)


class _Fold(StatefulProcessor):
    """What both processors share: the events of a micro-batch in order, and a timer that forgets a key."""

    def __init__(self, key: str, tie: str, state: str):
        self.key, self.tie, self.schema = key, tie, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Each call of the state store is a message to the JVM, so a key's state is read and written once, and its timer is set only if it moves."""
        before = self.state.get()
        known, told = before, Row(self.key, self.tie, *self.names)
        for row in sorted(rows, key=lambda r: (r["event_second"], r[self.tie] is None, r[self.tie])):
            known, said = self.step(known, row["event_second"], row["event_amount"])
            yield told(key[0], row[self.tie], *said)
        self.state.update(known)
        over = self.over(known) * 1000
        if before is None:
            self.handle.registerTimer(over)
        elif self.over(before) * 1000 != over:
            self.handle.deleteTimer(self.over(before) * 1000)
            self.handle.registerTimer(over)


class FixedWindows(_Fold):
    """The running amount of a key in its fixed window."""

    names = ("value", "within")

    def __init__(self, key: str, tie: str, size: int, limit: float, before: bool):
        super().__init__(key, tie, "window long, value double")
        self.size, self.limit, self.before = size, limit, before

    def step(self, known, second: int, amount: float):
        window = second // self.size
        value = known[1] if known is not None and known[0] == window else 0.0
        within = value < self.limit if self.before else value + amount <= self.limit
        return (window, value + amount), (value + amount, bool(within))

    def over(self, known) -> int:
        return (known[0] + 1) * self.size


class IdleSessions(_Fold):
    """The place of an event in its session, which ends after some idle time."""

    names = ("started", "place", "within")

    def __init__(self, key: str, tie: str, idle: int, most: int):
        super().__init__(key, tie, "started long, last long, n long")
        self.idle, self.most = idle, most

    def step(self, known, second: int, amount: float):
        started, last, n = known if known is not None and second - known[1] <= self.idle else (second, second, 0)
        return (started, second, n + 1), (started, n + 1, n + 1 <= self.most)

    def over(self, known) -> int:
        return known[1] + self.idle + 1


def _told(events: DataFrame, processor: _Fold, amount: Column, at: str, kinds: str, late: str) -> DataFrame:
    types = dict(events.dtypes)  # names that begin with an underscore don't reach the processor
    rows = events.withWatermark(at, late).select(processor.key, processor.tie, at, F.unix_timestamp(at).alias("event_second"), F.coalesce(amount, F.lit(0)).cast("double").alias("event_amount"))
    schema = f"`{processor.key}` {types[processor.key]}, `{processor.tie}` {types[processor.tie]}, {kinds}"
    return rows.groupBy(processor.key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def decided(events: DataFrame, key: str, amount: Column, *, limit: float, size: int, before: bool = False, at: str = "ts", tie: str = "event_id", late: str = LATE) -> DataFrame:
    """key, tie, value (the running amount of the key's window, this event included) and within: of the value, or of what stood before the event, against the limit."""
    return _told(events, FixedWindows(key, tie, size, limit, before), amount, at, "value double, within boolean", late)


def sessions(events: DataFrame, key: str, *, most: int, idle: int = 43_200, at: str = "ts", tie: str = "event_id", late: str = LATE) -> DataFrame:
    """key, tie, started (the second in which the event's session began), place (in it, from 1) and within: at most so many."""
    return _told(events, IdleSessions(key, tie, idle, most), F.lit(0), at, "started long, place long, within boolean", late)
