"""Search over the stand-in stories. SQL has no such stemming and ranking, so stories of a few known words stand beside the documents' own."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.listing import Filters
from tidewire.plans.registry import query
from tidewire.plans.stand_ins import NOW, STORIES, articles, sources, table
from tidewire.search import SearchIndex, build_postings, engine, search
from tidewire.search.query import parse
from tidewire.session import shared_dir


def _stories(spark, d):
    return articles(spark, d).withColumns({"keywords": F.lit(None).cast("string"), "author": F.lit(None).cast("string")})


@query("postings")
def postings(spark, d):
    return build_postings(_stories(spark, d)).select("term", "id", F.size("positions").alias("n"))


def _state_of(spark, d) -> str:
    """A name for the stored stories as they are now: the files' names, lengths and times of change, and who reads them."""
    files = sorted(table(spark, d, "documents").inputFiles())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = lambda f: hadoop.Path(spark.sparkContext._jvm.java.net.URI(f))
    known = [path(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path(f)) for f in files]
    return hashlib.sha256(repr([(f, s.getLen(), s.getModificationTime()) for f, s in zip(files, known, strict=True)]).encode()).hexdigest()[:24]


def _stored(spark, d, name: str, make) -> SearchIndex:
    """The index of these stories in the shared folder, written once for each state of the tables."""
    index = SearchIndex(spark, f"{shared_dir(spark)}/search-{name}-{_state_of(spark, d)}")
    if not index.version:
        index.add(make(spark, d))
    return index


@query("search_relevance")
def search_relevance(spark, d):
    a = _stories(spark, d)
    page, _ = search(a, sources(spark, d), _stored(spark, d, "stories", _stories).postings(), Filters(q='"of the" -ing or shannt'), NOW)
    return page.items.select("id", "title_marked", "snippet", F.round("rank", 9).alias("rank"))


@query("search_fuzzy")
def search_fuzzy(spark, d):
    """The longest word of the first title that has a long one, without its last letter: no story has it, some are like it."""
    a = _stories(spark, d)
    title = a.where("title RLIKE '[A-Za-z]{10}'").orderBy("id").select("title").first()["title"]  # one row
    asked = max(re.findall("[A-Za-z]+", title), key=len)[:-1]
    page, _ = search(a, sources(spark, d), _stored(spark, d, "stories", _stories).postings(), Filters(q=asked), NOW)
    return page.items.select("id", "title")


def _written(spark, d):
    """Stories of a few words, so that SQL can tell what matches."""
    pick = lambda n, *texts: F.get(F.array(*map(F.lit, texts)), (F.col("id") % n).cast("int"))
    return _stories(spark, d).withColumns({"title": pick(4, "Harbor storm", "Storms of the harbor", "Boats in the wind", "Markets open"), "intro": pick(3, "The running of boats", "No wind at the market", "A quiet day"), "section": F.lit(None).cast("string")})


_TITLE = "['Harbor storm', 'Storms of the harbor', 'Boats in the wind', 'Markets open'][1 + id % 4]"
_INTRO = "['The running of boats', 'No wind at the market', 'A quiet day'][1 + id % 3]"


@query("search_matches", f"{STORIES} SELECT id, 'phrase' AS q FROM articles WHERE id % 4 = 0 UNION ALL SELECT id, 'both' FROM articles WHERE id % 4 < 2 UNION ALL SELECT id, 'not' FROM articles WHERE (id % 4 = 2 OR id % 3 = 0) AND NOT (id % 4 = 2 OR id % 3 = 1) UNION ALL SELECT id, 'or' FROM articles WHERE id % 3 = 2 OR id % 4 = 3 UNION ALL SELECT id, 'none' FROM articles WHERE id % 4 > 1")
def search_matches(spark, d):
    a, index = _written(spark, d), _stored(spark, d, "written", _written).postings()
    asked = {"phrase": '"harbor storm"', "both": "stormed harbors", "not": "boat -wind", "or": "quiet or opened", "none": "-storm"}
    found = [engine.matched(a, index, parse(q)).select("id", F.lit(name).alias("q")) for name, q in asked.items()]
    return functools.reduce(DataFrame.unionByName, found)


@query(
    "search_ranked",
    f"""{STORIES}, r AS (SELECT id, published_at, {_TITLE} AS t, {_INTRO} AS i, CASE WHEN id % 4 = 3 THEN 1.0 ELSE 0 END + CASE WHEN id % 3 = 1 THEN 0.4 ELSE 0 END AS w FROM articles a WHERE source_id IN (SELECT id FROM sources))
SELECT id, regexp_replace(t, '(Markets)', '⟦\\1⟧') AS title_marked, regexp_replace(i, '(market)', '⟦\\1⟧') AS snippet, round(w / (w + 1), 9) AS rank FROM r WHERE w > 0 ORDER BY w / (w + 1) / (1 + date_diff('microsecond', published_at, TIMESTAMP '2024-02-01 12:00:00') / 1e6 / (86400 * 365.0)) DESC, published_at DESC, id DESC LIMIT 30""",
)
def search_ranked(spark, d):
    page, _ = search(_written(spark, d), sources(spark, d), _stored(spark, d, "written", _written).postings(), Filters(q="marketing"), NOW)
    return page.items.select("id", "title_marked", "snippet", F.round("rank", 9).alias("rank"))


@query(
    "search_topk",
    f"""{STORIES}, r AS (SELECT id, published_at, CASE WHEN id % 4 = 3 THEN 1.0 ELSE 0 END + CASE WHEN id % 3 = 1 THEN 0.4 ELSE 0 END AS w FROM articles)
SELECT id, round(w / (w + 1), 9) AS rank FROM r WHERE w > 0 ORDER BY w / (w + 1) / (1 + date_diff('microsecond', published_at, TIMESTAMP '2024-02-01 12:00:00') / 1e6 / (86400 * 365.0)) DESC, published_at DESC, id DESC LIMIT 30""",
)
def search_topk(spark, d):
    """The best 30 by impact blocks: blocks that can't reach the page are not ranked."""
    return _stored(spark, d, "written", _written).topk(parse("marketing"), NOW).select("id", F.round("rank", 9).alias("rank"))


@query("search_batches", f"""{STORIES}, r AS (SELECT id, {_TITLE} AS t FROM articles WHERE id % 5 < 4 OR id % 6 = 0), s AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'Quiet boats' ELSE t END AS t FROM r)
SELECT id, 'boat' AS q FROM s WHERE t LIKE '%oats%' UNION ALL SELECT id, 'harbor' FROM s WHERE t LIKE '%arbor%' UNION ALL SELECT id, 'quiet' FROM s WHERE t LIKE 'Quiet%'""")
def search_batches(spark, d):
    """Stories that come in three batches, the last of which changes titles; then the segments are merged."""
    a, i = _written(spark, d).withColumn("intro", F.lit(None).cast("string")), F.col("id")
    index = SearchIndex(spark, f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}", 8)
    for rows in (a.where(i % 5 < 2), a.where((i % 5).between(2, 3)), a.where(i % 6 == 0).withColumn("title", F.lit("Quiet boats"))):
        index.add(rows)
    index.merged()
    return functools.reduce(DataFrame.unionByName, [index.matched(parse(q)).select("id", F.lit(q).alias("q")) for q in ("boat", "harbor", "quiet")])


_ASKED = "harber storm"


@query(
    "similar_indexed",
    f"""{STORIES}, w AS (SELECT list_distinct(flatten([[substr('  ' || x || ' ', i::INT, 3) FOR i IN range(1, length(x) + 2)] FOR x IN regexp_extract_all('{_ASKED}', '[a-z]+')])) AS w),
t AS (SELECT id, published_at, {_TITLE} AS title FROM articles), h AS (SELECT title, flatten([[substr('  ' || x || ' ', i::INT, 3) FOR i IN range(1, length(x) + 2)] FOR x IN regexp_extract_all(lower(title), '[a-z]+')]) AS h FROM (SELECT DISTINCT title FROM t)),
p AS (SELECT title, w, list_distinct(h[a::INT:b::INT]) AS part FROM h, w, range(1, 60) AS x(a), range(1, 60) AS y(b) WHERE a <= b AND b <= len(h)),
v AS (SELECT title, max(len([g FOR g IN part IF list_contains(w, g)]) / (len(w) + len([g FOR g IN part IF NOT list_contains(w, g)]))) AS similarity FROM p GROUP BY title)
SELECT id, title, round(similarity, 9) AS similarity FROM t JOIN v USING (title) WHERE similarity >= 0.6 ORDER BY similarity DESC, published_at DESC, id DESC LIMIT 40""",
)
def similar_indexed(spark, d):
    """Titles like a misspelt query, by the stored trigrams; in SQL every stretch of every title."""
    return _stored(spark, d, "written", _written).similar(_ASKED, 40).select("id", "title", F.round("similarity", 9).alias("similarity"))


@query("search_without_words", f"{STORIES} SELECT id FROM articles WHERE list_contains(categories, 'en') AND source_id IN (SELECT id FROM sources) ORDER BY published_at DESC, id DESC LIMIT 30 OFFSET 30")
def search_without_words(spark, d):
    """A search for nothing but stop words is a listing, newest first."""
    page, _ = search(_written(spark, d), sources(spark, d), _stored(spark, d, "written", _written).postings(), Filters(q="the of", category="en"), NOW, page=2)
    return page.items.select("id")


@query("term_positions", f"{STORIES} SELECT 'storm' AS term, id, CASE WHEN id % 4 = 0 THEN '2' ELSE '1' END AS positions, 'A' AS weights FROM articles WHERE id % 4 < 2 UNION ALL SELECT 'run', id, CAST(len(string_split({_TITLE}, ' ')) + 2 AS VARCHAR), 'B' FROM articles WHERE id % 3 = 0")
def term_positions(spark, d):
    index = _stored(spark, d, "written", _written).postings(["storm", "run"]).where(F.col("term").isin("storm", "run"))
    return index.select("term", "id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), F.array_join("weights", "").alias("weights"))


_WORDS = r"regexp_extract_all(lower(text), '[a-z]+')"


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("trigram_count", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), g AS (SELECT DISTINCT doc_id, '  ' || w || ' ' AS p FROM w), t AS (SELECT DISTINCT doc_id, substr(p, CAST(i AS INT), 3) AS g FROM (SELECT doc_id, p, unnest(range(1, length(p) - 1)) AS i FROM g)) SELECT g, count(*) AS n FROM t GROUP BY 1")
def trigram_count(spark, d):
    return engine.trigram_counts(_texts(spark, d))


@query("term_stats", f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) SELECT w AS term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w GROUP BY 1")
def term_stats(spark, d):
    return engine.term_stats(_texts(spark, d))


@query("phrase_match", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])of[^a-z]the([^a-z]|$)')")
def phrase_match(spark, d):
    return _texts(spark, d).where(engine.contains_phrase(F.col("text"), "of the")).select(F.col("id").alias("doc_id"))


@query("recency_decay", "SELECT event_id, round(value / (1 + date_diff('microsecond', ts, TIMESTAMP '2024-03-01') / 1e6 / (86400 * 365.0)), 6) AS score FROM events")
def recency_decay(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(engine.decayed(F.col("value"), F.col("ts").cast("timestamp"), dt.datetime(2024, 3, 1, tzinfo=dt.UTC)), 6).alias("score"))
