"""The index against full builds and full rankings: batches, changes, merges, streams, blocks that are skipped, titles like a query."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.search import SearchIndex, analysis, build_postings, engine
from tidewire.search.index import STORY
from tidewire.search.query import parse

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
VOCABULARY = ["storm", "harbor", "boats", "running", "quiet", "market", "islands", "wind", "über", "school", "rain", "news"]


@pytest.fixture(scope="module")
def stories():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, n)))
    at = lambda: None if rng.random() < 0.03 else dt.datetime(2023, 1, 1) + dt.timedelta(days=rng.randint(0, 1094))
    return [(i, text(4).title() or None, text(14), None, rng.choice([None, "wind"]), None, at()) for i in range(900)]


def make(spark, rows):
    return spark.createDataFrame(rows, STORY)


def full_ranking(spark, rows, query, k):
    df = make(spark, rows)
    hits = engine.matched(df, build_postings(df), parse(query)).join(df.select("id", "published_at"), "id")
    scored = hits.withColumn("score", engine.decayed(F.col("rank"), F.col("published_at"), NOW))
    return [(r["id"], round(r["rank"], 9)) for r in scored.orderBy(F.desc("score"), F.col("published_at").desc_nulls_first(), F.desc("id")).limit(k).collect()]


def page(index, query, k):
    return [(r["id"], round(r["rank"], 9)) for r in index.topk(parse(query), NOW, k).collect()]


@pytest.fixture(scope="module")
def index(spark, stories, tmp_path_factory):
    out = SearchIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i", 4)
    out.add(make(spark, stories[:500]))
    out.add(make(spark, [(*r[:1], "Old title of a storm", *r[2:]) for r in stories[480:600]]))
    out.add(make(spark, stories[480:]))
    return out


@pytest.mark.parametrize("query", ["storm", "quiet market", '"harbor storm" or boats', "rain -wind", "über", "storm harbor boats wind rain", "nothere", "storm nothere or rain"])
def test_topk_is_the_full_ranking(spark, stories, index, query):
    assert page(index, query, 12) == full_ranking(spark, stories, query, 12)


def test_blocks_that_cannot_reach_the_page_are_not_ranked(spark, stories, index):
    assert page(index, "storm", 5) == full_ranking(spark, stories, "storm", 5)
    holders = index.postings(["storm"]).count()
    assert holders > 300 and index.ranked < 0.5 * holders
    assert len(page(index, "storm", 10_000)) == holders  # and all, if the page takes all


def test_topk_refuses_exclusions_alone(index):
    with pytest.raises(ValueError, match="exclusions"):
        index.topk(parse("-storm"), NOW)
    assert index.topk(parse("the of"), NOW).count() == 0


def test_batches_equal_a_full_build(spark, stories, index):
    columns = ["term", "id", "positions", "weights"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    whole = rows(build_postings(make(spark, stories)))
    assert rows(index.postings()) == whole and index.version == 3
    assert index.postings(["titl"]).count() == 0  # the titles that a later batch replaced
    copy = SearchIndex(spark, index.path + "-merged", 4)
    for part in (stories[:300], stories[200:]):
        copy.add(make(spark, part))
    assert copy.merged() == 3 and len(copy.manifest()["files"]) == 1 and rows(copy.postings()) == whole
    assert page(copy, "quiet market", 9) == page(index, "quiet market", 9) and copy.merged() == 3
    copy.add(make(spark, [(1, None, None, None, None, None, None), (2, "Zebra", "", None, None, None, None), (2, "Aardvark", "", None, None, None, None), (None, "Lost", "", None, None, None, None)]))
    assert copy.postings().where("id = 1").count() == 0 and [r["term"] for r in copy.postings().where("id = 2").collect()] == ["zebra"]
    assert copy.postings(["lost"]).count() == 0
    assert copy.add(make(spark, [])) == copy.version


def test_a_stream_feeds_the_index(spark, stories, tmp_path):
    """Batches by files; the last is delivered again after a crash, and many segments are merged."""
    index = SearchIndex(spark, f"file://{tmp_path}/i", 4)
    for k, part in enumerate((stories[:40], stories[30:60], stories[55:70])):
        make(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(STORY).parquet(str(tmp_path / "in/*"))
        index.fed(stream, str(tmp_path / "c"), most_segments=2).awaitTermination()
    assert index.last_batch == 2 and len(index.manifest()["files"]) == 1
    version = index.version
    for f in (tmp_path / "c/commits").glob("*2*"):
        f.unlink()
    index.fed(spark.readStream.schema(STORY).parquet(str(tmp_path / "in/*")), str(tmp_path / "c")).awaitTermination()
    assert index.version == version
    fresh = build_postings(make(spark, stories[:70]))
    assert sorted(map(str, index.postings().select(*fresh.columns).collect())) == sorted(map(str, fresh.collect()))


@pytest.mark.parametrize("q", ["harber storm", "boat", "quite markt", "isl", "", "??"])
def test_similar_titles_by_stored_trigrams(spark, stories, index, q):
    df = make(spark, stories)
    expected = [(r["id"], r["title"]) for r in engine.similar_titles(df, q, 25).collect()] if q.strip("?") else []
    assert [(r["id"], r["title"]) for r in index.similar(q, 25).collect()] == expected


def test_search_opens_the_folders_of_its_terms(spark, index):
    plan = index._part(index.manifest(), "postings", ["storm"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") + plan.count("PartitionFilters: [bucket") >= 3


def test_a_title_is_stored_once(spark, index):
    """Not with each of its trigrams, of which a title has as many as characters."""
    at = f"{index.path}/{index.manifest()['files']['000001'][0]}"
    assert set(spark.read.parquet(f"{at}/grams").columns) == {"g", "id", "bucket"}
    assert dict(spark.read.parquet(f"{at}/postings").dtypes)["weights"] == "string"


def test_postings_leave_python_a_few_stories_at_a_time(spark, stories):
    """Rows of one batch come back in many: what Python holds doesn't grow with the batch."""
    batches = engine.told_postings(make(spark, stories).coalesce(1), "published_at")
    assert batches.count() == engine.build_postings(make(spark, stories)).count()
    few = make(spark, stories[:3]).selectExpr("id", "'Harbor boats harbor' AS title", "intro", "keywords", "section", "author", "published_at")
    rows = {(r["id"], r["term"]): (list(r["positions"]), r["weights"]) for r in engine.told_postings(few).collect()}
    assert rows[(0, "harbor")][0][:2] == [1, 3] and rows[(0, "harbor")][1].startswith("AA")


def test_long_words_are_not_remembered():
    """200,000 of them would be as large as the texts that they come from."""
    known, long = {}, [chr(97 + k) * 5000 + "ing" for k in range(20)]
    found = analysis.tokens(" ".join(["storms", *long, "the", "Storms"]), known)
    assert [t for t, *_ in found] == ["storm", *map(analysis.term_of, long), None, "storm"] and [at for _, at, *_ in found] == list(range(1, 24))
    assert set(known) == {"storms", "the", "Storms"}


def test_postings_of_long_texts_leave_python_before_those_of_many_stories():
    texts = [f"harbor{k} " * 15_000 for k in range(60)] + ["quiet harbor", None, ""]
    fields = pa.struct([(c, pa.string()) for c in ("title", "intro", "rest")])
    batch = pa.RecordBatch.from_pylist([{"id": k, "_fields": {"title": "Storms", "intro": t, "rest": "harbor"}} for k, t in enumerate(texts)], pa.schema([("id", pa.int64()), ("_fields", fields)]))
    size = {k: len(t or "") + 12 for k, t in enumerate(texts)}
    out = list(engine.posting_batches(iter([batch]), ()))
    assert len(out) > 5 and all(sum(size[i] for i in set(b.column("id").to_pylist())) < engine.CHARACTERS_AT_ONCE + max(size.values()) for b in out)
    rows = {(r["id"], r["term"]): (r["positions"], r["weights"]) for b in out for r in b.to_pylist()}
    assert len(rows) == sum(b.num_rows for b in out) == 60 * 3 + 3 + 2 + 2
    assert rows[0, "harbor0"] == (list(range(2, 15_002)), "B" * 15_000) and rows[0, "harbor"] == ([15_002], "C")
    assert rows[60, "harbor"] == ([3, 4], "BC") and rows[61, "harbor"] == ([2], "C") and rows[62, "storm"] == ([1], "A")
