"""From candidates to stored stories: what is new, what is due, what is accepted, what is stored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.keywords import Topic, classify, mentions
from tidewire.functions.text import clean_byline, credits_a_builder, feed_summary, first_among, fold, truncate
from tidewire.functions.urls import match_key, same_site

MAX_ATTEMPTS = 5
HTML_TYPES = ("text/html", "application/xhtml+xml")


def due_at(attempts: Column, last: Column) -> Column:
    """When a failed page may be tried again: 1, 2, 4, 8 hours after its attempts."""
    return F.timestamp_micros(F.unix_micros(last) + (F.pow(F.lit(2), F.greatest(attempts, F.lit(1)) - 1) * 3_600_000_000).cast("long"))


def waiting(seen: DataFrame, now: dt.datetime) -> DataFrame:
    """Pages that must not be tried now: rejected, given up, or before their time."""
    return seen.where((F.col("status") == "rejected") | (F.col("attempts") >= MAX_ATTEMPTS) | (due_at(F.col("attempts"), F.col("last_attempt_at")) > F.lit(now)))


def retries(seen: DataFrame, now: dt.datetime) -> DataFrame:
    """Failed pages whose time has come, as candidates."""
    due = seen.where((F.col("status") == "failed") & (F.col("attempts") < MAX_ATTEMPTS) & (due_at(F.col("attempts"), F.col("last_attempt_at")) <= F.lit(now)))
    return due.select("source_id", "url", F.col("url").alias("key"), F.lit("retry").alias("via"))


def newest_first() -> list[Column]:
    """Dated candidates newest first, undated ones behind them in page order."""
    return [F.col("published_at").desc_nulls_last(), F.col("pos").asc(), F.col("key").asc()]


def filter_new(candidates: DataFrame, articles: DataFrame, seen: DataFrame, now: dt.datetime) -> DataFrame:
    """Candidates that are neither stored, under any spelling or alias, nor waiting. Two anti joins, each on one key."""
    spellings = articles.select(F.explode(F.array_compact(F.array("url", "discovered_url"))).alias("u")).select(match_key(F.col("u")).alias("_m")).distinct()
    first = Window.partitionBy("key").orderBy("pos")
    rows = candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("_m", match_key(F.col("key")))
    return rows.join(spellings, "_m", "left_anti").drop("_m").join(waiting(seen, now).select(F.col("url").alias("key")), "key", "left_anti")


def capped(candidates: DataFrame, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """The first `most` candidates of each source, and the rest, which stay pending."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*newest_first()))
    rows = candidates.withColumn("_rank", rank)
    return rows.where(F.col("_rank") <= most).drop("_rank"), rows.where(F.col("_rank") > most).drop("_rank")


def pending_merged(before: DataFrame, now_pending: DataFrame, read: DataFrame) -> DataFrame:
    """Pending candidates after a round: those of sources not read stay, those of sources read are replaced."""
    return before.join(read.select("source_id").distinct(), "source_id", "left_anti").unionByName(now_pending, allowMissingColumns=True)


def excluded_label(labels: Column, unwanted: Column) -> Column:
    """The first label that is among the unwanted ones, compared without case and accents, as it is written."""
    return first_among(labels, unwanted)


def prefiltered(candidates: DataFrame, sources: DataFrame, places: tuple[str, ...]) -> DataFrame:
    """candidates with `reason`: why the feed alone rejects one, or null. sources has id, exclude_sections and require_place."""
    rows = candidates.join(sources.select(F.col("id").alias("source_id"), "exclude_sections", "require_place"), "source_id")
    label = excluded_label(F.col("tags"), F.col("exclude_sections"))
    text = fold(F.concat_ws(" ", "title", "summary", "url", F.array_join("tags", " ")))
    away = F.col("require_place") & (F.col("via") == "feed") & F.col("title").isNotNull() & ~mentions(text, places)
    reason = F.when(label.isNotNull(), F.concat(F.lit("excluded section: "), label)).when(away, F.lit("not about the place"))
    return rows.withColumn("reason", reason).drop("exclude_sections", "require_place")


def drafts(candidates: DataFrame, fetched: DataFrame, sources: DataFrame, topics: list[Topic], places: tuple[str, ...], now: dt.datetime) -> DataFrame:
    """Every candidate with its fetched page as a draft: status (ok, rejected, failed, throttled), reason and the story's columns.

    fetched has url, http_status, robots, content_type, page_url and the columns of extracted pages; sources has id, name, categories,
    exclude_sections, require_place, feed_only, max_age_days, undated, vouching and only_in_topic. One projection, no state.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "exclude_sections", "require_place", "feed_only", "max_age_days", "undated", "vouching", "only_in_topic", F.col("categories").alias("forced"))
    page = fetched.select(F.col("url"), "http_status", "robots", "content_type", "page_url", *(F.col(c).alias(f"x_{c}") for c in ("canonical_url", "title", "intro", "description", "image_url", "published_at", "author", "section", "keywords", "site_name", "is_article")))
    r = candidates.join(s, "source_id").join(page, "url", "left")
    c, no_text = F.col, F.lit(None).cast("string")
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    # step by step, so that no expression is repeated inside another
    r = r.withColumn("_alone", c("feed_only") & (c("via") == "feed")).withColumn("_page", ~c("_alone") & F.coalesce(c("http_status") == 200, F.lit(False)))
    own = lambda name: F.when(c("_page"), c(f"x_{name}"))
    usable = same_site(own("canonical_url"), c("url")) & ~own("canonical_url").rlike(r"^https?://[^/]+/?$")
    r = r.withColumns({"_final": F.when(c("_page"), F.coalesce("page_url", "key")).otherwise(c("key")), "_title": truncate(F.coalesce(own("title"), "title"), 300), "_summary": feed_summary(c("summary"))})
    r = r.withColumns({"_url": F.when(usable, c("x_canonical_url")).otherwise(c("_final")), "_intro": truncate(F.coalesce(own("intro"), own("description"), "_summary"), 800), "_at": F.least(F.coalesce(own("published_at"), "published_at", F.lit(now)), F.lit(now))})
    plain = lambda x: F.lower(F.trim(x, F.lit(" .")))
    r = r.withColumns({"_intro": F.when(plain(c("_intro")) != plain(c("_title")), c("_intro")), "_section": own("section"), "_labels": F.coalesce(F.when(F.size(own("keywords")) > 0, own("keywords")), "tags", F.array().cast("array<string>"))})
    r = r.withColumns({"_keywords": F.nullif(F.substring(F.array_join(F.array_distinct(F.filter("_labels", lambda x: x != "")), ", "), 1, 1000), F.lit("")), "_label": excluded_label(F.concat(F.array_compact(F.array("_section")), c("_labels")), c("exclude_sections"))})
    r = r.withColumn("_about", mentions(fold(F.concat_ws(" ", "_title", "_intro", "_url", "_keywords", "_section")), places))
    code, robots = c("http_status"), F.coalesce("robots", F.lit(False))
    readable = (c("via") == "feed") & c("title").isNotNull() & (code.isin(401, 403, 451) | robots)
    vouched = c("vouching") & (c("x_published_at").isNotNull() | c("undated")) & c("x_intro").isNotNull()
    fetching = (
        F.when(c("_alone") | readable, None)
        .when(code == 429, said("throttled", "asked to slow down"))
        .when(robots, said("rejected", "disallowed by robots.txt"))
        .when(code.isin(404, 410), said("rejected", F.concat(F.lit("gone ("), code.cast("string"), F.lit(")"))))
        .when(code.isNull() | (code != 200), said("failed", F.concat(F.lit("HTTP "), F.coalesce(code.cast("string"), F.lit("no answer")))))
        .when(~F.coalesce("content_type", F.lit("")).isin(*HTML_TYPES), said("rejected", F.concat(F.lit("not HTML ("), F.coalesce("content_type", F.lit("")), F.lit(")"))))
        .when((c("via") != "feed") & ~F.coalesce("x_is_article", F.lit(False)) & ~F.coalesce(vouched, F.lit(False)), said("rejected", "not an article page"))
    )
    content = (
        F.when(F.coalesce("_title", F.lit("")) == "", said("failed", "no headline found"))
        .when((c("via") == "listing") & (c("_at") < F.lit(now) - F.make_interval(days=c("max_age_days"))), said("rejected", F.concat(F.lit("older than "), c("max_age_days").cast("string"), F.lit(" days"))))
        .when(c("_label").isNotNull(), said("rejected", F.concat(F.lit("excluded section: "), c("_label"))))
        .when(c("require_place") & ~c("_about"), said("rejected", "not about the place"))
        .otherwise(said("ok", no_text))
    )
    r = r.withColumn("_said", F.coalesce(fetching, content))
    topics_of = classify(topics, c("_title"), c("_intro"), c("_section"), c("_keywords"), c("_url"), c("forced"), c("only_in_topic"))
    author = clean_byline(F.coalesce(own("author"), "author"), c("source_name"), own("site_name"))
    named = {"url": "_url", "title": "_title", "intro": "_intro", "section": "_section", "keywords": "_keywords", "published_at": "_at"}
    return r.select("source_id", "key", "pos", "_said.status", "_said.reason", *(c(v).alias(k) for k, v in named.items()), F.when(c("key") != c("_url"), c("key")).alias("discovered_url"), author.alias("author"), topics_of.alias("categories"), F.coalesce(own("image_url"), "image_url").alias("image_url"))


def rebylined(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """The stored stories whose byline changes once site credits and the source's own name are taken off, with the new one. sources has id and name."""
    rows = articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("_name")), "source_id")
    bare = F.lower(F.regexp_replace("_name", r"(?i)^the\s+", ""))
    suspect = F.lower("author").contains(bare) | credits_a_builder(F.col("author"))
    new = rows.where(suspect).withColumn("_new", clean_byline(F.col("author"), F.col("_name")))
    return new.where(~F.col("_new").eqNullSafe(F.col("author"))).withColumn("author", F.col("_new")).select(*articles.columns)


def reused_images(articles: DataFrame, new: DataFrame, ignored: DataFrame, now: dt.datetime, days: int = 60, uses: int = 2) -> DataFrame:
    """source_id, image_url that become generic: pictures that a story brings after `uses` recent ones of its source, stored or before it in this round."""
    recent = articles.where((F.col("published_at") >= F.lit(now - dt.timedelta(days=days))) & F.col("image_url").isNotNull()).groupBy("source_id", "image_url").agg(F.count("*").alias("n"))
    brought = new.where("image_url IS NOT NULL").groupBy("source_id", "image_url").agg(F.count("*").alias("k"))
    found = brought.join(recent, ["source_id", "image_url"], "left").where(F.coalesce("n", F.lit(0)) + F.col("k") - 1 >= uses)
    return found.select("source_id", "image_url").join(ignored.select(F.col("url").alias("image_url")), "image_url", "left_anti")


def earlier_uses(articles: DataFrame, order: str = "id") -> DataFrame:
    """articles with a picture, and how often their source had used it before, in `earlier`."""
    before = Window.partitionBy("source_id", "image_url").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return articles.where("image_url IS NOT NULL").withColumn("earlier", F.count("*").over(before))


def without_images(rows: DataFrame, generic: DataFrame) -> DataFrame:
    """rows with the image columns of generic pictures emptied."""
    g = generic.select("source_id", "image_url", F.lit(True).alias("_g")).distinct()
    joined = rows.join(g, ["source_id", "image_url"], "left")
    cleared = [F.when(F.col("_g").isNull(), F.col(c)).alias(c) if c in ("image_url", "image_path", "image_width", "image_height") else F.col(c) for c in rows.columns]
    return joined.select(*cleared)


def usable_size(width: Column, height: Column, fmt: Column) -> Column:
    """Whether a picture is one to show: large enough, not too narrow, of a known format."""
    ratio = width / height
    return (width >= 200) & (height >= 120) & ratio.between(0.2, 5.0) & F.upper(fmt).isin("JPEG", "PNG", "WEBP", "GIF", "MPO")


def image_name(url: Column) -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 24), F.lit(".webp"))


def bot_check(headers: Column, status: Column, body: Column) -> Column:
    """The service whose bot check a page is, `unknown` if it can't be told, or null. headers is a map with lower-case keys."""
    raw = F.coalesce(body, F.lit("")).cast("binary")
    head = F.lower(F.substring(raw, 1, 50_000).cast("string"))
    server = F.lower(F.coalesce(headers["server"], F.lit("")))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(headers["content-type"], F.lit("")), ";", 1)))
    title = r"<title[^>]*>\s*(just a moment|one moment, please|attention required|please wait|checking your browser|ddos-guard|access denied)"
    shown = headers["x-amzn-waf-action"].isNotNull() | (status == 202) & head.contains("javascript is disabled") | head.rlike(title)
    # challenge pages are small; articles often are not
    checked = kind.isin("", "text/html") & F.octet_length(raw).between(1, 200_000) & shown
    service = (
        F.when(headers["cf-ray"].isNotNull() | (server == "cloudflare"), "Cloudflare")
        .when(head.contains("sgcaptcha"), "SiteGround")
        .when(server.contains("akamai"), "Akamai")
        .when(headers["x-sucuri-id"].isNotNull() | head.contains("sucuri"), "Sucuri")
        .when(head.contains("_incapsula_resource") | headers["x-iinfo"].isNotNull(), "Imperva")
        .when(head.contains("ddos-guard"), "DDoS-Guard")
        .when(headers["x-amzn-waf-action"].isNotNull() | head.contains("awswaf"), "AWS WAF")
        .otherwise("unknown")
    )
    return (
        F.when(headers["cf-mitigated"].isNotNull() | (server.contains("cloudflare") & status.isin(403, 503) & head.rlike("just a moment|challenge-platform|attention required")), "Cloudflare")
        .when(head.rlike("sucuri website firewall") | headers["x-sucuri-id"].isNotNull() & status.isin(403, 503), "Sucuri")
        .when(head.rlike("incapsula incident|_incapsula_resource"), "Imperva")
        .when(head.rlike("px-captcha|perimeterx"), "PerimeterX")
        .when(head.rlike("geo.captcha-delivery.com|datadome"), "DataDome")
        .when(checked, service)
    )
