"""Streaming forms: windowed counts with late data, first-seen stories, and retry memory with backoff as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ingest import MAX_ATTEMPTS
from tidewire.operators.state import VersionedTable


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Events per window and kind; batch or stream. A stream keeps windows open for `late`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of users: start, end and number of events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(candidates: DataFrame, late: str = "7 days") -> DataFrame:
    """Each key once, within the time that state is kept."""
    return candidates.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["key"])


def retry_memory(outcomes: DataFrame) -> DataFrame:
    """Of a stream of outcomes (url, status, at) the state after each batch: attempts, status and when the page is due. Stored pages are forgotten."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, _ = state.get if state.exists else (0, "")
        rows = pd.concat(list(batches)).sort_values("at")
        for status, at in zip(rows["status"], rows["at"], strict=True):
            attempts, last, status_now = (0 if status == "ok" else attempts + 1), at, status
        if status_now == "ok":
            if state.exists:
                state.remove()
        else:
            state.update((attempts, status_now))
        due = None if status_now in ("ok", "rejected") or attempts >= MAX_ATTEMPTS else last + pd.Timedelta(hours=2 ** (attempts - 1))
        yield pd.DataFrame({"url": [key[0]], "status": [status_now], "attempts": pd.array([attempts], "int32"), "due_at": pd.to_datetime(pd.Series([due]))})

    return outcomes.groupBy("url").applyInPandasWithState(update, "url string, status string, attempts int, due_at timestamp", "attempts int, status string", "update", "NoTimeout")


def upsert_stream(stream: DataFrame, table: VersionedTable, merge, checkpoint: str):
    """Starts a query that merges each batch into a versioned table: merge(current, batch) gives the next version.

    A version names the batch that made it, so a batch that is delivered again after a crash is merged once. A table belongs to one stream.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = table.last_batch
        if last is None or number > last:
            table.write(merge(table.read(), batch), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
