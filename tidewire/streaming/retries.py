"""Memory of failed pages as state with timers: a page that is due asks for its retry itself, and what is old is forgotten.

The same rules as `ingest.due_after` in batches: a failed page is due 1, 2, 4 and 8 hours after its attempts and given up at the fifth; a
rejected one is never due; a stored one is forgotten. A page without an outcome for `keep_days` is forgotten, too, so state is
bounded by the pages of that time. Needs the RocksDB state store (`with_state_store`).

By event time the watermark moves the clock, so replays give the same retries; by processing time the cluster's clock does, and the state's own
time to live forgets. Outcomes with a null url or a null time are left out; outcomes of a batch count in order of time, equal ones by status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.ingest import MAX_ATTEMPTS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "url string, event string, status string, attempts int, at timestamp"
HELD = "status string, attempts int, last long, due long, ends long"
HOUR = 3_600_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class Retries(StatefulProcessor):
    """State of one page: status, attempts, time of the last one, and the timers that are set (0: none)."""

    def __init__(self, keep_ms: int, by_clock: bool):
        self.keep_ms, self.by_clock = keep_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", HELD, self.keep_ms if self.by_clock else None)

    def _row(self, key, event: str, status: str, attempts: int, at_ms: int | None) -> pd.DataFrame:
        return pd.DataFrame({"url": [key[0]], "event": [event], "status": [status], "attempts": pd.array([attempts], "int32"), "at": pd.to_datetime(pd.Series([at_ms]), unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, last, due, ends = self.page.get() if self.page.exists() else ("", 0, 0, 0, 0)
        for timer in (due, ends):
            if timer:
                self.handle.deleteTimer(timer)
        new = pd.concat(list(rows)).sort_values(["at", "status"])
        for said, at in zip(new["status"], new["at"], strict=True):
            attempts, status, last = (0 if said == "ok" else attempts + 1), said, max(last, int(at.timestamp() * 1000))
        if status == "ok":
            self.page.clear()
            yield self._row(key, "stored", status, 0, last)
            return
        due = last + HOUR * 2 ** (attempts - 1) if status != "rejected" and attempts < MAX_ATTEMPTS else 0
        ends = 0 if self.by_clock else last + self.keep_ms
        for timer in (due, ends):
            if timer:
                self.handle.registerTimer(timer)
        self.page.update((status, attempts, last, due, ends))
        yield self._row(key, "remembered", status, attempts, due or None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.page.exists():
            return
        status, attempts, last, due, ends = self.page.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired == ends:
            if due:
                self.handle.deleteTimer(due)
            self.page.clear()
            yield self._row(key, "forgotten", status, attempts, ends)
        elif fired == due:
            self.page.update((status, attempts, last, 0, ends))
            yield self._row(key, "retry", status, attempts, due)

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, late: str = "0 seconds", keep_days: float = 90, by_clock: bool = False) -> DataFrame:
    """Of a stream of outcomes (url, status, at) what happens to each page: remembered (at: when it is due), retry (it is due now), stored, forgotten."""
    rows = outcomes.where("url IS NOT NULL AND at IS NOT NULL").select("url", F.coalesce("status", F.lit("failed")).alias("status"), "at")
    if not by_clock:
        rows = rows.withWatermark("at", late)
    processor = Retries(int(keep_days * 24 * HOUR), by_clock)
    return rows.groupBy("url").transformWithStateInPandas(processor, OUT, "append", "processingTime" if by_clock else "eventTime")
