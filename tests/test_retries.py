"""Pages' memory with timers, on a clock that the test moves: retries when they are due, as batches reckon them, and an end."""

from __future__ import annotations

import datetime as dt
import time

import pytest

from tidewire.operators import ingest
from tidewire.schemas import SCHEMAS
from tidewire.streaming.retries import retries, with_state_store

START = dt.datetime(2026, 1, 1)
IN = "url string, status string, at timestamp"


@pytest.fixture
def steps(spark, tmp_path):
    """Gives a batch to the stream, which begins anew from its checkpoint each time: what it says then."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    n = [0]

    def step(rows, **options):
        n[0] += 1
        spark.createDataFrame(rows, IN).coalesce(1).write.parquet(str(tmp_path / f"in/{n[0]}"))
        stream = with_state_store(spark).readStream.schema(IN).parquet(str(tmp_path / "in/*"))
        q = retries(stream, **options).writeStream.outputMode("append").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(str(tmp_path / f"out/{n[0]}"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        told = spark.read.schema("url string, event string, status string, attempts int, at timestamp").parquet(str(tmp_path / f"out/{n[0]}"))
        return sorted((r["url"], r["event"], r["attempts"], None if r["at"] is None else (r["at"] - START) / dt.timedelta(hours=1)) for r in told.collect())

    yield step
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_retries_when_due_and_forgetting(spark, steps):
    got = steps([("a", "failed", at(0)), ("b", "rejected", at(0)), ("c", "ok", at(0)), ("d", "failed", at(0)), ("d", "failed", at(0.5)), (None, "failed", at(0)), ("e", None, at(0.25))])
    assert got == [("a", "remembered", 1, 1.0), ("b", "remembered", 1, None), ("c", "stored", 0, 0.0), ("d", "remembered", 2, 2.5), ("e", "remembered", 1, 1.25)]
    # the clock moves to hour 1.1: a is due, e and d are not
    got = steps([("clock", "ok", at(1.1))])
    assert ("a", "retry", 1, 1.0) in got and not any(u in "de" for u, event, *_ in got if event == "retry")
    # a fails again in time, d is due at 2.5, e was stored before it was due
    got = steps([("a", "failed", at(1.2)), ("e", "ok", at(1.2))])
    assert ("a", "remembered", 2, 3.2) in got and ("e", "stored", 0, 1.2) in got
    got = steps([("clock", "ok", at(5))])
    assert {g for g in got if g[1] == "retry"} == {("d", "retry", 2, 2.5), ("a", "retry", 2, 3.2)}
    # up to the fifth attempt, after which it is never due
    got = steps([("a", "failed", at(6 + k)) for k in range(3)])
    assert [g for g in got if g[0] == "a"] == [("a", "remembered", 5, None)]
    assert not [g for g in steps([("clock", "ok", at(200))]) if g[1] == "retry"]
    # 90 days after its last outcome a page is forgotten, and begins anew if it comes again
    got = steps([("clock", "ok", at(24 * 90 + 50))])
    assert {(u, event) for u, event, *_ in got if event == "forgotten"} == {("a", "forgotten"), ("b", "forgotten"), ("d", "forgotten")}
    got = steps([("a", "failed", at(24 * 93))])
    assert [g for g in got if g[0] == "a"] == [("a", "remembered", 1, 24 * 93 + 1.0)]


def test_due_as_batches_reckon(spark, steps):
    """Every page that the stream asks to retry is one that the batch rule calls due at that hour, and no other."""
    rows = [(f"u{k}", "failed", at(k % 3)) for k in range(6)]
    told = steps(rows) + steps([("clock", "ok", at(2.5))])  # the first hours pass with the rows themselves
    got = {u for u, event, *_ in told if event == "retry"}
    seen = spark.createDataFrame([(u, 1, s, "x", 1, t, t) for u, s, t in rows], SCHEMAS["seen_urls"])
    assert got == {r["url"] for r in ingest.retries(seen, at(2.5).replace(tzinfo=dt.UTC)).collect()} == {"u0", "u1", "u3", "u4"}


def test_time_to_live_by_the_clock(spark, steps):
    now = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
    keep = 4 / 86400
    assert [g[:3] for g in steps([("a", "failed", now())], by_clock=True, keep_days=keep)] == [("a", "remembered", 1)]
    time.sleep(6)
    got = steps([("a", "failed", now())], by_clock=True, keep_days=keep)
    assert [g[:3] for g in got] == [("a", "remembered", 1)]  # what was remembered is gone
