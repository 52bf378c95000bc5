"""What a source's pages give a round: links of listing pages, entries of feeds, of feeds that listing pages advertise, posts and sitemaps.

A page that is as it was when last read gives nothing, by its status (304) or by the hash of its content; listing pages of a source whose feeds
are looked for count every time, as only they tell of the feeds. What a page was like is remembered once its source has nothing left
to fetch, so that a round that stopped half-way finds the rest again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.urls import looks_like_article, same_site
from tidewire.schemas import SCHEMAS
from tidewire.sources.apis import parse_posts
from tidewire.sources.pages import advertised_feeds, parse_feeds, parse_listings, parse_sitemaps

CANDIDATE = [c.split()[0] for c in SCHEMAS["candidates"].split(", ")]
#: Columns of a source that discovery needs.
RULES = "slug string, homepage string, autodiscover boolean, article_patterns array<string>, exclude array<string>"


def any_pattern(url: str, patterns: str) -> Column:
    """Whether one of a column of patterns is found in a column's address, regardless of case."""
    return F.expr(f"exists(coalesce({patterns}, array()), p -> {url} RLIKE concat('(?i)', p))")


def with_answers(pages: DataFrame) -> DataFrame:
    """pages with the columns of an answer that they lack: read, without validators."""
    given = {"http_status": F.lit(200), "etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")}
    return pages.withColumns({c: v for c, v in given.items() if c not in pages.columns}).withColumn("content_hash", F.when(F.col("http_status") == 200, F.sha2(F.col("content").cast("binary"), 256)))


def changed(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """The pages that a round has to read: answered, and not as the cache knows them."""
    known = cache.select(F.col("url").alias("_url"), F.col("content_hash").alias("_hash"))
    same = F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False)) & ~((F.col("kind") == "listing") & F.col("autodiscover"))
    return pages.join(known, F.col("url") == F.col("_url"), "left").where((F.col("http_status") == 200) & ~same).drop("_url", "_hash")


def cache_updates(pages: DataFrame, pending: DataFrame, now: dt.datetime) -> DataFrame:
    """What to remember of the pages that answered, of sources that have nothing pending."""
    done = pages.where("http_status = 200").join(pending.select("source_id").distinct(), "source_id", "left_anti")
    return done.select("url", "etag", "last_modified", "content_hash", F.lit(now).cast("timestamp").alias("checked_at")).dropDuplicates(["url"])


def discovered(pages: DataFrame, log: DataFrame, now: dt.datetime) -> DataFrame:
    """Candidates with source_id and pos, of pages (source_id, the columns of RULES, kind, url, content); kinds: feed, listing, sitemap, posts.

    Feeds that a listing page advertises are read from the log (url, http_status, content), if they are in it and no configured ones. A feed's entries
    must be of its own site or the source's; what a source's patterns exclude is no candidate.
    """
    rules = [c.split()[0] for c in RULES.split(", ")]
    owner = pages.select(F.col("url").alias("page_url"), "source_id", *rules).dropDuplicates(["page_url", "source_id"])
    of = lambda kind: pages.where(F.col("kind") == kind)
    wanted = F.when(F.size(F.coalesce("page_article_patterns", F.array())) > 0, any_pattern("url", "page_article_patterns")).otherwise(looks_like_article(F.col("url")))
    listing = of("listing").select("url", "content", "article_patterns").dropDuplicates(["url"])
    links = parse_listings(listing, wanted=wanted).join(owner, "page_url")
    told = advertised_feeds(of("listing").where("autodiscover").select("url", "content")).join(owner, "page_url").drop("page_url").dropDuplicates(["url", "source_id"])
    told = told.join(of("feed").select("url", "source_id"), ["url", "source_id"], "left_anti")
    found = told.join(log.where("http_status = 200").select("url", "content"), "url")
    columns = ["url", "content", "source_id", *rules]
    feeds = of("feed").select(*columns).unionByName(found.select(*columns))
    feed_owner = feeds.select(F.col("url").alias("page_url"), "source_id", *rules).dropDuplicates(["page_url", "source_id"])
    entries = parse_feeds(feeds.select("url", "content").dropDuplicates(["url"]), now).join(feed_owner, "page_url")
    entries = entries.where(same_site(F.col("url"), F.col("page_url")) | F.coalesce(same_site(F.col("url"), F.col("homepage")), F.lit(False)))
    posts = parse_posts(of("posts").select("url", "content").dropDuplicates(["url"]), "").join(owner, "page_url")
    posts = posts.withColumn("tags", F.array(F.regexp_extract("page_url", r"/r/([^/?#]+)", 1)))
    maps = parse_sitemaps(of("sitemap").select("url", "content").dropDuplicates(["url"]), now).where("kind = 'url'").join(owner, "page_url")
    maps = maps.where(F.when(F.size(F.coalesce("article_patterns", F.array())) > 0, any_pattern("loc", "article_patterns")).otherwise(looks_like_article(F.col("loc"))))
    nothing = {c: F.lit(None).cast("string").alias(c) for c in ("title", "summary", "image_url", "author")}
    at = F.pmod(F.xxhash64("loc"), F.lit(1 << 29)).cast("int").alias("pos")  # a sitemap's order says nothing
    maps = maps.select("source_id", "exclude", at, F.col("loc").alias("url"), F.col("loc").alias("key"), F.lit("sitemap").alias("via"), *nothing.values(), F.col("lastmod").alias("published_at"), F.lit(None).cast("array<string>").alias("tags"))
    out = maps.select("source_id", "exclude", "pos", *CANDIDATE)
    for rows in (links, entries, posts):
        out = out.unionByName(rows.select("source_id", "exclude", F.col("pos").cast("int").alias("pos"), *CANDIDATE))
    return out.where(~any_pattern("url", "exclude")).drop("exclude")
