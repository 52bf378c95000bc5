"""One round of ingest: from what was discovered to the next state of every table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.config import Config
from tidewire.functions.keywords import Topic, reclassified
from tidewire.operators import discovery, ingest, runs, state
from tidewire.schemas import SCHEMAS
from tidewire.sources.pages import extract_articles, merged_candidates

#: Columns of pages that wait, and of extracted pages beside their address.
PENDING = "source_id int, pos int, url string, key string, via string, title string, summary string, image_url string, published_at timestamp, author string, tags array<string>"
EXTRACTED = ("canonical_url", "title", "intro", "description", "image_url", "published_at", "author", "section", "keywords", "site_name", "is_article")
STORED = {"articles": SCHEMAS["articles"], "seen": SCHEMAS["seen_urls"], "pending": PENDING, "ignored_images": SCHEMAS["ignored_images"], "runs": SCHEMAS["scrape_runs"]}


#: Tables in buckets of a key, of which a round rewrites those that its pages fall into.
KEYED = {"articles": "url", "seen": "url", "http_cache": "url"}


@dataclass(frozen=True)
class Tables:
    """The state that a round reads and replaces. pending has the columns of candidates."""

    articles: DataFrame
    seen: DataFrame
    pending: DataFrame
    ignored_images: DataFrame
    runs: DataFrame


@dataclass(frozen=True)
class Round:
    """What a round makes of what was found: drafts of stories, an outcome of every page that was tried, pictures that became generic, and the small tables' next rows."""

    drafts: DataFrame
    outcomes: DataFrame
    generic: DataFrame
    pending: DataFrame
    ignored_images: DataFrame
    runs: DataFrame


def judged_round(tables: Tables, found: DataFrame, fetch: Callable[[DataFrame], DataFrame], sources: DataFrame, topics: list[Topic], places: tuple[str, ...], now: dt.datetime, most: int = 40, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows, read: DataFrame | None = None) -> Round:
    """A round over what the sources' pages gave (found: candidates with source_id, pos and the rest).

    Pages that wait from earlier rounds and failed ones that are due join what was found; what is stored, waits or is rejected
    by its feed alone is left out; each source's newest `most` are fetched (fetch gives the fetch log with the extracted columns) and the
    rest stays pending. read (source_id) are the sources that were read, also those whose pages gave nothing; without it those that gave
    something. keep(rows, name) may write what several tables are made of and read it again, so that it is computed once.
    """
    due = ingest.retries(tables.seen, now)
    every = found.unionByName(tables.pending, allowMissingColumns=True).unionByName(due, allowMissingColumns=True)
    one = merged_candidates(every.withColumn("pos", F.coalesce("pos", F.lit(1 << 30))), by=("source_id", "key"))
    new = ingest.filter_new(one, tables.articles, tables.seen, now)
    judged = keep(ingest.prefiltered(new, sources, places), "candidates")
    now_, later = ingest.capped(judged.where("reason IS NULL").drop("reason"), most)
    drafts = keep(ingest.drafts(now_, fetch(now_), sources, topics, places, now), "drafts")
    _, duplicates = state.stored_articles(tables.articles, drafts, now, start=0)
    generic = ingest.reused_images(tables.articles, drafts.where("status = 'ok'"), tables.ignored_images, now)
    ignored = tables.ignored_images.unionByName(generic.select(F.col("image_url").alias("url"), "source_id", F.lit(now).cast("timestamp").alias("created_at")).dropDuplicates(["url"]))
    early = judged.where("reason IS NOT NULL").select(F.col("key").alias("url"), "source_id", F.lit("rejected").alias("status"), "reason")
    outcomes = drafts.select(F.col("key").alias("url"), "source_id", "status", "reason").unionByName(early)
    # a duplicate is a rejected page, though its draft was good
    outcomes = outcomes.join(duplicates.select("url"), "url", "left_anti").unionByName(duplicates)
    read = (found if read is None else read).select("source_id").distinct()
    pending = ingest.pending_merged(tables.pending, later, read).select(*tables.pending.columns)
    tried = outcomes.groupBy("source_id").agg(F.count("*").alias("candidates"), F.sum((F.col("status") == "ok").cast("int")).alias("new_articles"), F.sum((F.col("status") == "failed").cast("int")).alias("failed"), F.lit(None).cast("string").alias("error"))
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "new_articles", "failed")]
    log = runs.closed(runs.opened(tables.runs, read, now), read.join(tried, "source_id", "left").select("source_id", *nothing, "error"), now)
    return Round(drafts, outcomes, generic, pending, ignored, log)


def ingest_round(tables: Tables, found: DataFrame, fetch: Callable[[DataFrame], DataFrame], sources: DataFrame, topics: list[Topic], places: tuple[str, ...], now: dt.datetime, most: int = 40, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> Tables:
    """The tables after a round: accepted stories are stored without pictures that became generic, and every outcome is remembered."""
    r = judged_round(tables, found, fetch, sources, topics, places, now, most, keep)
    articles, _ = state.stored_articles(tables.articles, r.drafts, now)
    return Tables(ingest.without_images(articles, r.generic), state.remembered(tables.seen, r.outcomes, now), r.pending, r.ignored_images, r.runs)


def stored_tables(spark: SparkSession, folder: str) -> dict[str, state.VersionedTable]:
    """The tables of a folder by the names of `Tables`, and the sources."""
    at = folder.rstrip("/")
    every = STORED | {"sources": SCHEMAS["sources"], "http_cache": SCHEMAS["http_cache"]}
    return {name: state.BucketedTable(spark, f"{at}/{name}", schema, KEYED[name]) if name in KEYED else state.VersionedTable(spark, f"{at}/{name}", schema) for name, schema in every.items()}


def run_round(spark: SparkSession, folder: str, pages: DataFrame, log: DataFrame, config: Config, now: dt.datetime, most: int = 40) -> dict[str, int]:
    """A round over the tables of a folder, whose next versions it writes: the numbers of rows by table.

    pages (slug, kind, url, content, and http_status, etag, last_modified if they are known) are the feeds, listing pages, sitemaps and posts that were read; log (url, http_status, robots, content_type,
    page_url, content) is what was fetched of the addresses that candidates have, also of ones that no candidate has. The sources are brought in line
    with the configuration first. The articles' lease keeps a second writer out; of the stories and of the memory of pages only buckets that the round's pages fall into are rewritten.
    """
    tables = stored_tables(spark, folder)
    with tables["articles"].exclusive():
        told = config.sources_frame(spark)
        tables["sources"].write(state.synced(tables["sources"].read(), told.select("slug", "name", "homepage", "enabled")))
        ids = tables["sources"].read().select("id", "slug")
        sources = told.join(ids, "slug")
        owned = discovery.with_answers(pages).join(ids.withColumnRenamed("id", "source_id"), "slug").join(config.rules_frame(spark), "slug")

        def keep(rows: DataFrame, name: str) -> DataFrame:
            scratch = state.VersionedTable(spark, f"{folder.rstrip('/')}/scratch-{name}", ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))
            scratch.write(rows)
            scratch.keep(1)
            return scratch.read()

        def fetch(wanted: DataFrame) -> DataFrame:
            mine = log.join(wanted.select(F.col("key").alias("url")).distinct(), "url", "left_semi")
            told = extract_articles(mine.where("http_status = 200").select("url", "content"), now).select("url", *EXTRACTED)
            return mine.drop("content").join(told, "url", "left")

        before = Tables(**{name: tables[name].read() for name in STORED})
        cache = tables["http_cache"].read()
        found = discovery.discovered(keep(discovery.changed(owned, cache), "pages"), log, now)
        r = judged_round(before, keep(found, "found"), fetch, sources, list(config.topics), config.places, now, most, keep, owned.select("source_id"))
        after, generic = {name: getattr(r, name) for name in STORED if name not in KEYED}, keep(r.generic, "generic")
        outcomes, start = keep(r.outcomes, "outcomes"), state.greatest(before.articles)
        for name, rows in after.items():  # all read the versions before, so the order doesn't matter
            tables[name].write(rows)
        tables["articles"].merge(r.drafts.where("status = 'ok'"), lambda old, new: state.stored_articles(old, new, now, start)[0])
        pictured = tables["articles"].read().join(generic, ["source_id", "image_url"], "left_semi")
        tables["articles"].merge(ingest.without_images(pictured, generic), lambda old, new: state.upserted(old, new, "url"))
        tables["seen"].merge(outcomes, lambda old, new: state.remembered(old, new, now))
        # last: a page counts as read once what it gave is stored
        answers = discovery.cache_updates(owned, tables["pending"].read(), now)
        tables["http_cache"].merge(answers, lambda old, new: state.upserted(old, new, "url"))
    return {name: table.read().count() for name, table in tables.items()}


def reclassify(spark: SparkSession, folder: str, config: Config) -> int:
    """Gives the stored stories of a folder the topics that the configuration gives them now; how many changed."""
    tables = stored_tables(spark, folder)
    with tables["articles"].exclusive():
        articles = tables["articles"].read()
        told = config.sources_frame(spark).select("slug", F.col("categories").alias("forced"), F.col("only_in_topic").alias("only"))
        changed = reclassified(articles, list(config.topics), tables["sources"].read().select("id", "slug").join(told, "slug"))
        n = changed.count()
        if n:
            tables["articles"].merge(changed, lambda old, new: state.upserted(old, new, "url"))
    return n
