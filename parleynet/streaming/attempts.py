"""Attempts by key as a stream with state: done at the first success, given up after some failures, due again some time after a failure."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "key string, status string, fails int, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys that share a row of state and a timer: a call to the state store costs more than the work on a key.
BUCKETS = 1024


class Attempts(StatefulProcessor):
    """For each key the number of failures, whether it is done, and when the next attempt is due; a group holds the keys of a bucket.

    Rows (key, ok, us: microseconds of the time) of a batch count by time; what comes after
    a success or the last failure changes nothing. A change is a row: `done`, `given up`, or
    `due` when the watermark has passed a failure by `wait_ms` and nothing has happened
    since. The bucket's timer is that of the key that is due first.
    """

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "keys array<string>, fails array<int>, over array<boolean>, timers array<long>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, first = self._held()
        changes = []
        for name, (failures, success, last) in self._earliest(rows).items():
            fails, over, timer = held.get(name, (0, False, None))
            if over:
                continue
            before = [t for t in failures if success is None or t <= success]
            if fails + len(before) >= self.most:
                fails, over, last, status = self.most, True, before[self.most - fails - 1], "given up"
            else:
                fails, over, last, status = fails + len(before), success is not None, success or last, "done"
            if over:
                changes.append((name, status, fails, last))
            held[name] = (fails, over, None if over else last // 1000 + self.wait_ms)
        self._hold(held, first)
        yield _frame(changes)

    def _earliest(self, rows: Iterator[pd.DataFrame]) -> dict[str, list]:
        """For each key the first failures of a batch, as many as could matter, its first success and its last time; a key's rows are never all held."""
        found: dict[str, list] = {}
        for part in rows:
            for name, ok, at in zip(part["key"].tolist(), part["ok"].tolist(), part["us"].tolist()):
                seen = found.setdefault(name, [[], None, at])
                failures, success, last = seen
                if ok:
                    seen[1] = at if success is None or at < success else success
                elif len(failures) < self.most or at < failures[-1]:
                    insort(failures, at)
                    del failures[self.most :]
                if at > last:
                    seen[2] = at
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, first = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        due = [(name, "due", fails, timer * 1000) for name, (fails, _, timer) in held.items() if timer is not None and timer <= now]
        held.update({name: (fails, False, None) for name, _, fails, _ in due})
        # The timer that has run out is gone already.
        self._hold(held, None if first == expiredTimerInfo.getExpiryTimeInMs() else first)
        yield _frame(due)

    def _held(self) -> tuple[dict[str, tuple[int, bool, int | None]], int | None]:
        """(fails, over, due time) by key, and the bucket's timer."""
        if not self.state.exists():
            return {}, None
        keys, fails, over, timers, first = self.state.get()
        return dict(zip(keys, zip(fails, over, timers))), first

    def _hold(self, held: dict[str, tuple[int, bool, int | None]], before: int | None) -> None:
        fails, over, timers = (list(x) for x in zip(*held.values()))
        first = min((t for t in timers if t is not None), default=None)
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((list(held), fails, over, timers, first))

    def close(self) -> None:
        pass


def _frame(changes: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(changes, columns=["key", "status", "fails", "us"])
    return out.astype({"key": "object", "status": "object", "fails": "int32", "us": "int64"})


def attempt_changes(attempts: DataFrame, most: int = 4, wait: str = "1 day", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """CHANGES of a stream attempts(key string, ok boolean, at timestamp); a null key, outcome or time is no attempt.

    State is a few numbers a key, kept by bucket, and lives in the query's checkpoint, so counts go on across
    restarts. Rows later than the watermark are left out.
    """
    rows = attempts.where("key IS NOT NULL AND ok IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    processor = Attempts(most, int(pd.Timedelta(wait).total_seconds() * 1000))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "ok", "at", F.unix_micros("at").alias("us"))
    changes = rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType="key string, status string, fails int, us long", outputMode="append", timeMode="EventTime")
    return changes.select("key", "status", "fails", F.timestamp_micros("us").alias("at"))


def use_rocks(spark: SparkSession) -> None:
    """State of processors needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
