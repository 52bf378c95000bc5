"""Listings, archive, facets, status and job queries, with the same queries as SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidewire.operators import days as D
from tidewire.operators import jobs as J
from tidewire.operators import listing as L
from tidewire.plans.registry import query
from tidewire.plans.stand_ins import JOBS, NOW, STORIES, TODAY, articles, boards, jobs, sources
from tidewire.session import shared_dir

HIDDEN = ("src1", "src7")
FILTER = L.Filters(category="en", date_from=dt.date(2024, 1, 3), date_to=dt.date(2024, 1, 28), sort="newest", hide_sources=HIDDEN)
_WHERE = "list_contains(categories, 'en') AND published_at >= TIMESTAMP '2024-01-02 14:00:00' AND published_at < TIMESTAMP '2024-01-28 14:00:00' AND source_id NOT IN (SELECT id FROM sources WHERE slug IN ('src1', 'src7'))"


@query("listing_page", f"{STORIES} SELECT a.id, s.slug AS source_slug, s.name AS source_name, a.title FROM articles a JOIN sources s ON s.id = a.source_id WHERE {_WHERE} ORDER BY published_at DESC, a.id DESC LIMIT 30 OFFSET 30")
def listing_page(spark, d):
    return L.list_articles(articles(spark, d), sources(spark, d), FILTER, page=2, per_page=30).items.select("id", "source_slug", "source_name", "title")


@query("listing_oldest", f"{STORIES} SELECT a.id, a.title FROM articles a JOIN sources s ON s.id = a.source_id WHERE s.slug = 'src7' ORDER BY published_at, a.id LIMIT 30")
def listing_oldest(spark, d):
    return L.list_articles(articles(spark, d), sources(spark, d), L.Filters(source="src7", sort="oldest", hide_sources=HIDDEN)).items.select("id", "title")


@query("listing_total", f"{STORIES} SELECT count(*) AS total FROM articles WHERE {_WHERE}")
def listing_total(spark, d):
    return L.narrowed(articles(spark, d), sources(spark, d), FILTER).agg(F.count("*").alias("total"))


@query("hidden_anti_join", f"{STORIES} SELECT id FROM articles WHERE source_id NOT IN (SELECT id FROM sources WHERE slug IN ('src1', 'src7'))")
def hidden_anti_join(spark, d):
    return L.visible(articles(spark, d), sources(spark, d), HIDDEN).select("id")


@query("facet_array", f"{STORIES} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM articles WHERE published_at >= TIMESTAMP '2024-01-10') GROUP BY 1")
def facet_array(spark, d):
    return L.category_counts(articles(spark, d), dt.datetime(2024, 1, 10, tzinfo=dt.UTC))


@query("facet_zero_groups", f"{STORIES} SELECT slug, name, homepage, count(a.id) AS n FROM sources s LEFT JOIN articles a ON a.source_id = s.id AND a.published_at >= TIMESTAMP '2024-02-11' WHERE s.enabled GROUP BY 1, 2, 3")
def facet_zero_groups(spark, d):
    return L.source_counts(articles(spark, d), sources(spark, d), dt.datetime(2024, 2, 11, tzinfo=dt.UTC))


@query("offered_sources", f"{STORIES} SELECT slug, name FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM articles GROUP BY 1) a ON a.source_id = s.id WHERE n > 0 OR slug IN ('silent')")
def offered_sources(spark, d):
    return L.offered_sources(articles(spark, d), sources(spark, d), {"silent"})


@query("last_updated", f"{STORIES} SELECT max(last_run_at) AS last_run_at FROM sources")
def last_updated(spark, d):
    return L.last_updated(sources(spark, d))


@query("month_counts", f"{STORIES} SELECT CAST(year(published_at + INTERVAL 10 HOUR) AS INT) AS year, CAST(month(published_at + INTERVAL 10 HOUR) AS INT) AS month, count(*) AS n FROM articles GROUP BY 1, 2")
def month_counts(spark, d):
    return L.month_counts(articles(spark, d))


@query("day_counts", f"{STORIES} SELECT CAST(CAST(published_at + INTERVAL 10 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM articles WHERE CAST(published_at + INTERVAL 10 HOUR AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1")
def day_counts(spark, d):
    return L.day_counts(articles(spark, d), 2024, 1).withColumn("day", F.col("day").cast("string"))


@query("neighbour_days", f"{STORIES} SELECT CAST(CAST(max(published_at) FILTER (WHERE published_at < TIMESTAMP '2024-01-09 14:00:00') + INTERVAL 10 HOUR AS DATE) AS VARCHAR) AS before, CAST(CAST(min(published_at) FILTER (WHERE published_at >= TIMESTAMP '2024-01-10 14:00:00') + INTERVAL 10 HOUR AS DATE) AS VARCHAR) AS after FROM articles")
def neighbour_days(spark, d):
    return L.neighbour_days(articles(spark, d), dt.date(2024, 1, 10)).select(F.col("before").cast("string"), F.col("after").cast("string"))


@query("neighbour_months", f"{STORIES}, m AS (SELECT DISTINCT CAST(date_trunc('month', published_at + INTERVAL 10 HOUR) AS DATE) AS month FROM articles) SELECT CAST(month AS VARCHAR) AS month, CAST(lag(month) OVER (ORDER BY month) AS VARCHAR) AS previous, CAST(lead(month) OVER (ORDER BY month) AS VARCHAR) AS next FROM m")
def neighbour_months(spark, d):
    return L.neighbour_months(articles(spark, d)).select(*(F.col(c).cast("string") for c in ("month", "previous", "next")))


@query(
    "sitemap_times",
    f"""{STORIES}, v AS (SELECT *, CAST(published_at + INTERVAL 10 HOUR AS DATE) AS day FROM articles WHERE source_id NOT IN (SELECT id FROM sources WHERE slug IN ('src1', 'src7')))
SELECT 'all' AS kind, '' AS name, max(published_at) AS newest FROM v UNION ALL
SELECT 'category', category, max(published_at) FROM (SELECT unnest(categories) AS category, published_at FROM articles) GROUP BY 2 UNION ALL
SELECT 'source', slug, max(published_at) FROM articles a JOIN sources s ON s.id = a.source_id GROUP BY 2 UNION ALL
SELECT 'day', CAST(day AS VARCHAR), max(published_at) FROM v GROUP BY 2 UNION ALL SELECT 'month', strftime(day, '%Y-%m'), max(published_at) FROM v GROUP BY 2""",
)
def sitemap_times(spark, d):
    return L.sitemap_times(articles(spark, d), sources(spark, d), HIDDEN)


@query(
    "source_status",
    f"""{STORIES} SELECT s.slug, s.enabled, count(a.id) AS total, count(a.id) FILTER (WHERE first_seen_at >= TIMESTAMP '2024-01-31 12:00:00') AS day,
count(a.id) FILTER (WHERE first_seen_at >= TIMESTAMP '2024-01-25 12:00:00') AS week, max(published_at) AS latest FROM sources s LEFT JOIN articles a ON a.source_id = s.id GROUP BY 1, 2""",
)
def source_status(spark, d):
    return L.source_status(articles(spark, d), sources(spark, d), NOW).select("slug", "enabled", "total", "day", "week", "latest")


@query("recent_runs", f"{STORIES} SELECT r.event_id AS id, s.name AS source_name, ts AS started_at FROM events r JOIN sources s ON s.id = r.user_id % 20 ORDER BY ts DESC, r.event_id DESC LIMIT 40")
def recent_runs(spark, d):
    runs = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).cast("int").alias("source_id"), F.col("ts").cast("timestamp").alias("started_at"))
    return L.recent_runs(runs, sources(spark, d)).select("id", "source_name", "started_at")


@query("day_groups", f"{STORIES}, p AS (SELECT id, CAST(published_at + INTERVAL 10 HOUR AS DATE) AS day FROM articles ORDER BY published_at DESC, id DESC LIMIT 30) SELECT CAST(day AS VARCHAR) AS day, CASE day WHEN DATE '2024-02-01' THEN 'Today · ' WHEN DATE '2024-01-31' THEN 'Yesterday · ' ELSE '' END || strftime(day, '%A, %B %-d, %Y') AS label, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id DESC) AS ids FROM p GROUP BY 1, 2")
def day_groups(spark, d):
    page = L.list_articles(articles(spark, d), sources(spark, d), L.Filters(sort="newest")).items
    return L.day_groups(page, NOW).select(F.col("day").cast("string"), "label", F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("ids"))


_OPEN = "removed_at IS NULL AND (close_date IS NULL OR close_date >= DATE '2024-02-01')"


@query("open_jobs", f"{JOBS} SELECT j.id, j.title, b.name AS source_name FROM jobs j JOIN boards b ON b.id = j.source_id WHERE {_OPEN} AND b.enabled ORDER BY coalesce(open_date, CAST(first_seen_at AS DATE)) DESC, j.id DESC LIMIT 30")
def open_jobs(spark, d):
    return J.list_jobs(jobs(spark, d), boards(spark), TODAY).items.select("id", "title", "source_name")


@query("job_search", f"{JOBS} SELECT j.id FROM jobs j JOIN boards b ON b.id = j.source_id WHERE {_OPEN} AND b.enabled AND contains(lower(concat_ws(' ', title, employer, location, description)), 'brand#1')")
def job_search(spark, d):
    return J.open_jobs(jobs(spark, d), boards(spark), TODAY, q="Bránd#1").select("id")


@query("board_counts", f"{JOBS} SELECT b.slug, count(j.id) FILTER (WHERE {_OPEN}) AS open FROM boards b LEFT JOIN jobs j ON j.source_id = b.id WHERE b.enabled GROUP BY 1")
def board_counts(spark, d):
    return J.board_counts(jobs(spark, d), boards(spark), TODAY).select("slug", "open")


@query(
    "snapshot_merge",
    f"""{JOBS}, o AS (SELECT * FROM jobs WHERE source_id = 1 AND id % 3 <> 0), n AS (SELECT url, 'new ' || title AS title, CASE WHEN id % 2 = 0 THEN '' ELSE 'other' END AS employer FROM jobs WHERE source_id = 1 AND id % 3 <> 1)
SELECT coalesce(n.url, o.url) AS url, coalesce(n.title, o.title) AS title, CASE WHEN n.employer <> '' THEN n.employer ELSE o.employer END AS employer,
CASE WHEN n.url IS NOT NULL THEN NULL ELSE coalesce(o.removed_at, TIMESTAMP '2024-02-01 12:00:00') END AS removed_at,
CASE WHEN o.url IS NULL THEN TIMESTAMP '2024-02-01 12:00:00' ELSE o.first_seen_at END AS first_seen_at FROM o FULL JOIN n ON o.url = n.url""",
)
def snapshot_merge(spark, d):
    every = jobs(spark, d)
    extra = {"pay": "string", "close_note": "string", "pdf_url": "string", "last_seen_at": "timestamp", "detail_fetched_at": "timestamp"}
    every = every.withColumns({k: F.lit(None).cast(t) for k, t in extra.items()})
    stored = every.where("source_id <> 1 OR id % 3 <> 0")
    listed = every.where("source_id = 1 AND id % 3 <> 1").select("url", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("id") % 2 == 0, "").otherwise("other").alias("employer"), *(F.lit(None).cast("string").alias(c) for c in ("pay", "description", "location", "close_note", "pdf_url")), *(F.lit(None).cast("date").alias(c) for c in ("open_date", "close_date")))
    twice = listed.withColumn("pos", F.lit(1)).unionByName(listed.withColumns({"pos": F.lit(2), "title": F.lit("listed again"), "employer": F.lit("none")}))
    return J.reconciled(stored, twice, 1, NOW).where("source_id = 1").select("url", "title", "employer", "removed_at", "first_seen_at")


def _days(spark, d):
    """The stories by day, from three batches: of the second half days are late, and of the third rows are there already."""
    a = articles(spark, d).select("id", "source_id", "categories", "published_at")
    store = D.DayStore(spark, f"{shared_dir(spark)}/days-{uuid.uuid4().hex}", "id long, source_id int, categories array<string>, published_at timestamp")
    for rows in (a.where("id % 3 > 0"), a.where("id % 3 = 0"), a.where("id % 9 = 0 AND id % 2 = 0").withColumn("categories", F.array(F.lit("late")))):
        store.merge(rows)
    return store


@query(
    "rolled_times",
    f"""{STORIES}, b AS (SELECT source_id, published_at, CASE WHEN id % 9 = 0 AND id % 2 = 0 THEN ['late'] ELSE categories END AS categories, CAST(published_at + INTERVAL 10 HOUR AS DATE) AS day FROM articles), v AS (SELECT * FROM b WHERE source_id NOT IN (SELECT id FROM sources WHERE slug IN ('src1', 'src7')))
SELECT 'all' AS kind, '' AS name, max(published_at) AS newest FROM v UNION ALL
SELECT 'category', category, max(published_at) FROM (SELECT unnest(categories) AS category, published_at FROM b) GROUP BY 2 UNION ALL
SELECT 'source', slug, max(published_at) FROM b a JOIN sources s ON s.id = a.source_id GROUP BY 2 UNION ALL
SELECT 'day', CAST(day AS VARCHAR), max(published_at) FROM v GROUP BY 2 UNION ALL SELECT 'month', strftime(day, '%Y-%m'), max(published_at) FROM v GROUP BY 2""",
)
def rolled_times(spark, d):
    """Last-modified times from the days' totals."""
    return D.sitemap_times(_days(spark, d).totals(), sources(spark, d), HIDDEN)


@query("rolled_days", f"{STORIES} SELECT CAST(CAST(published_at + INTERVAL 10 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM articles WHERE CAST(published_at + INTERVAL 10 HOUR AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1")
def rolled_days(spark, d):
    return D.day_counts(_days(spark, d).totals(), 2024, 1).withColumn("day", F.col("day").cast("string"))
