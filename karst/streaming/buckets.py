"""A token bucket for each key of a stream, as typed state with timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What the state of a key needs of Spark.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBucket(StatefulProcessor):
    """Events wait in the state store until the watermark has passed their time, so they are taken in order of time whatever
    order they come in; each is looked at alone. A bucket that time has filled up again is dropped: a key without one has a full
    one. So state is the events of the watermark's delay, and two numbers for each key that isn't idle."""

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.per_second = float(capacity), float(per_second)

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level double, last long")
        self.waiting = handle.getMapState("waiting", "millis long", "events string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = (row.micros // 1000,)
            held = json.loads(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
            self.waiting.updateValue(at, (json.dumps([*held, [row.micros, row.event_id]]),))
            if not held:
                self.handle.registerTimer(at[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        level, last = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        if not self.waiting.containsKey(at):  # a bucket that may be full by now
            if last is not None and level + (at[0] * 1000 - last) / 1e6 * self.per_second >= self.capacity:
                self.bucket.clear()
            return
        for micros, event_id in sorted(json.loads(self.waiting.getValue(at)[0])):
            level = min(self.capacity, level + max(0, micros - (micros if last is None else last)) / 1e6 * self.per_second)
            last = micros
            allowed = level >= 1
            after = 0 if allowed else int(-(-(1 - level) // self.per_second))
            yield Row(key=key[0], event_id=event_id, micros=micros, allowed=allowed, retry_after=after)
            level -= allowed
        self.waiting.removeKey(at)
        self.bucket.update((level, last))
        self.handle.registerTimer(last // 1000 + 1 + int((self.capacity - level) / self.per_second * 1000) + 1)

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, capacity: float, per_second: float, late: str = "1 minute") -> DataFrame:
    """key, event_id, ts, allowed, retry_after (whole seconds) of a stream's events once the watermark has passed them; as
    rate_limited gives for a batch. Later events than `late` are dropped. Needs the state store PROVIDER."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark("ts", late).select(F.col(key).alias("key"), F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("micros"))
    out = timed.groupBy("key").transformWithState(TokenBucket(capacity, per_second), f"key {kind}, event_id long, micros long, allowed boolean, retry_after int", "append", "EventTime")
    return out.select(F.col("key").alias(key), "event_id", F.timestamp_micros("micros").alias("ts"), "allowed", "retry_after")
