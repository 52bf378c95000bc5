"""Days as partitions: late rows, totals against the stories themselves, and what a query opens."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import days, listing

SCHEMA = "id long, source_id int, categories array<string>, title string, published_at timestamp"
START = dt.datetime(2025, 12, 20, 3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, rng.randint(1, 4), rng.sample(["a", "b", "c"], rng.randint(0, 2)), f"t{i}", None if i % 50 == 0 else START + dt.timedelta(minutes=rng.randint(0, 40 * 1440))) for i in range(400)]


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted(map(str, df.collect()))


def test_totals_follow_the_stories(spark, rows, tmp_path):
    store = days.DayStore(spark, f"file://{tmp_path}/s", SCHEMA)
    sources = spark.createDataFrame([(i, f"s{i}") for i in range(1, 5)], "id int, slug string")
    store.merge(make(spark, rows[:300]))
    store.merge(make(spark, rows[250:]), batch=4)
    changed = [(i, 1, ["z"], "new", at) for i, _, _, _, at in rows[10:13]]
    store.merge(make(spark, changed))
    now = make(spark, rows[:10] + changed + rows[13:])
    assert told(store.read().select(*now.columns)) == told(now) and store.last_batch == 4
    kept = now.where("published_at IS NOT NULL")
    assert told(days.month_counts(store.totals().where("day IS NOT NULL"))) == told(listing.month_counts(kept))
    for month in ((2025, 12), (2026, 1), (2026, 3)):
        assert told(days.day_counts(store.totals(), *month)) == told(listing.day_counts(now, *month))
    for d in (dt.date(2025, 12, 20), dt.date(2026, 1, 5), dt.date(2026, 6, 1)):
        assert told(days.neighbour_days(store.totals(), d)) == told(listing.neighbour_days(kept, d))
    for hide in ((), ("s2",)):
        assert told(days.sitemap_times(store.totals().where("day IS NOT NULL"), sources, hide)) == told(listing.sitemap_times(kept, sources, hide))
    assert store.merge(make(spark, [])) == store.version


def test_late_rows_change_their_day_only(spark, rows, tmp_path):
    store = days.DayStore(spark, f"file://{tmp_path}/s", SCHEMA)
    store.merge(make(spark, rows))
    before = store.manifest()["files"]
    late = dt.datetime(2025, 12, 25, 3)  # the 25th on the local calendar, too
    store.merge(make(spark, [(1000, 1, ["a"], "late", late)]))
    after = store.manifest()["files"]
    assert {n for n in after if before.get(n) != after[n]} == {"rows/2025-12-25", "totals/2025-12-25"}
    assert store.between(dt.date(2025, 12, 25), dt.date(2025, 12, 25)).where("id = 1000").count() == 1
    # a row that gets another day: with moves it leaves the day it had
    moved = [(1000, 1, ["a"], "moved", late + dt.timedelta(days=2))]
    store.merge(make(spark, moved), moves=True)
    assert [r["day"] for r in store.with_days().where("id = 1000").collect()] == [dt.date(2025, 12, 27)]


def test_a_range_opens_its_days_only(spark, rows, tmp_path):
    store = days.DayStore(spark, f"file://{tmp_path}/s", SCHEMA)
    store.merge(make(spark, rows))
    counts = days.day_counts(store.totals(), 2026, 1)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    some = store.between(dt.date(2026, 1, 3), dt.date(2026, 1, 4))
    opened = {f for r in some.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"].split("day=")[1][:10]]}
    assert opened == {"2026-01-03", "2026-01-04"}
    assert some.where(F.to_date(F.from_utc_timestamp("published_at", days.ZONE)) != F.col("day")).count() == 0


def test_many_small_days_share_partitions(spark, tmp_path, monkeypatch):
    """Files follow the rows and not the days: spans of days, widened when later batches bring more, with the same answers."""
    monkeypatch.setattr(days, "PARTITIONS", 8)
    monkeypatch.setattr(days, "ROWS_A_PARTITION", 1000)
    monkeypatch.setattr(days, "ROWS_A_FILE", 100)
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 3), rng.sample(["a", "b"], rng.randint(0, 2)), f"t{i}", None if i == 7 else START + dt.timedelta(hours=i * 11)) for i in range(500)]
    store, sources = days.DayStore(spark, f"file://{tmp_path}/s", SCHEMA), spark.createDataFrame([(i, f"s{i}") for i in range(1, 4)], "id int, slug string")
    spans = []
    for part in (rows[:10], rows[:60], rows[60:], rows[100:103]):
        store.merge(make(spark, part))
        spans.append(store._span(store.manifest()))
        assert len(store._files(store.manifest(), "totals")) <= 10
    assert spans[0] == 1 < spans[1] < spans[2] == spans[3]
    now = make(spark, rows)
    assert told(store.read().select(*now.columns)) == told(now)
    kept = now.where("published_at IS NOT NULL")
    assert told(days.sitemap_times(store.totals().where("day IS NOT NULL"), sources)) == told(listing.sitemap_times(kept, sources))
    assert told(days.day_counts(store.totals(), 2026, 2)) == told(listing.day_counts(now, 2026, 2))
    day = dt.date(2026, 2, 3)
    assert told(store.between(day, day).select("id")) == told(now.where(F.to_date(F.from_utc_timestamp("published_at", days.ZONE)) == F.lit(day)).select("id"))
    # a row that moves leaves the span it had, and a late one changes its own span only
    store.merge(make(spark, [(3, 1, ["a"], "moved", START + dt.timedelta(days=200))]), moves=True)
    assert store.with_days().where("id = 3").count() == 1
    before = store.manifest()["files"]
    store.merge(make(spark, [(1000, 1, ["a"], "late", START + dt.timedelta(days=50))]))
    after = store.manifest()["files"]
    assert len({n for n in after if before.get(n) != after[n]}) == 2
