"""Feeds, listing pages, sitemaps and article pages as DataFrames: raw bytes in, rows out."""

from __future__ import annotations

import datetime as dt
import gc
import gzip
import re
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tidewire.functions import html as H
from tidewire.functions.dates import parse_datetime, parsed
from tidewire.functions.text import clean, clean_text, first_distinct, headline, intro
from tidewire.functions.urls import excluded, host_of, looks_like_article, match_key, normalize_url, normalized, path_shape, same_site, shows_nothing, unwrap_redirect

IMG = re.compile(r"<img[^>]+src=[\"']([^\"']+)", re.I)
ENTRY = "url string, pos int, title string, summary string, image string, published string, author string, tags array<string>"


def _local(tag) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _xml(content: bytes | str | None):
    raw = content.encode() if isinstance(content, str) else content or b""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if b"<!ENTITY" in raw[:10_000]:
        return None
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def feed_entries(content: bytes | str | None) -> list[tuple]:
    """The entries of an RSS, RDF or Atom feed, in order. A damaged feed has none."""
    root, out = _xml(content), []
    for n in root.iter() if root is not None else ():
        if _local(n.tag) not in ("item", "entry"):
            continue
        parts: dict[str, list] = {}
        for c in n.iter():
            parts.setdefault(_local(c.tag), []).append(c)
        text = lambda *names, parts=parts: next((t for k in names for c in parts.get(k, []) if (t := "".join(c.itertext()).strip())), None)
        link = next((c.get("href") for c in parts.get("link", []) if c.get("href") and c.get("rel", "alternate") == "alternate"), None) or text("link")
        guid = text("guid", "id") or ""
        link = link or (guid if guid.startswith("http") else None)
        if not link:
            continue
        summary = text("description", "summary") or text("encoded", "content")
        media = [c for c in parts.get("content", []) if c.get("url") and ("image" in (c.get("medium") or c.get("type") or "image").lower() or re.search(r"\.(jpe?g|png|webp)(\?|$)", c.get("url"), re.I))]
        image = next((c.get("url") for c in (*media, *(c for c in parts.get("thumbnail", []) if c.get("url")), *(c for c in parts.get("enclosure", []) if (c.get("type") or "").startswith("image")))), None)
        blocks = [t for k in ("description", "summary", "encoded", "content") for c in parts.get(k, []) if (t := "".join(c.itertext()))]
        image = image or next((m[1] for b in blocks if (m := IMG.search(b))), None)
        author = next((t for c in parts.get("creator", []) + parts.get("author", []) if (t := clean(" ".join(x.strip() for x in c.itertext() if x.strip() and "@" not in x)))), None)
        tags = [clean(c.get("term") or c.text) for c in parts.get("category", []) if clean(c.get("term") or c.text)]
        if re.match(r"https?://([^/]+\.)?reddit\.com/", link):
            body = H.tree(summary)
            inner = next((x for x in body.all("div") if x.has_class("md")), None)
            picture = next((a.attrs.get("href", "") for a in body.all("a") if a.text() == "[link]"), "")
            image = picture if re.search(r"\.(jpe?g|png|webp|gif)$", picture.partition("?")[0], re.I) else None
            summary, author = inner.text() if inner else "", author.lstrip("/") if author else None
        out.append((link, len(out), clean(text("title")) or None, H.strip_html(summary) or None, image, text("pubdate", "published", "date", "updated"), author or None, tags))
    return out


def sitemap_rows(content: bytes | str | None) -> list[tuple]:
    """(kind, loc, lastmod): pages and child sitemaps of a sitemap, zipped or not."""
    root, out = _xml(content), []
    for n in root if root is not None else ():
        kind = _local(n.tag)
        if kind not in ("url", "sitemap"):
            continue
        value = lambda *names, n=n: next((c.text.strip() for c in n.iter() if _local(c.tag) in names and (c.text or "").strip()), None)
        if loc := value("loc"):
            out.append(("sitemap" if kind == "sitemap" or _local(root.tag) == "sitemapindex" else "url", loc, value("lastmod", "publication_date")))
    return out


#: Pages whose rows Python holds at once.
PAGES_AT_ONCE = 100


def rows_of(pages: DataFrame, f: Callable[..., Iterable[tuple]], schema: str, given: list[str], kept: dict[str, str]) -> DataFrame:
    """The rows (tuples of a schema) that f makes of each page's given columns, beside those of the page's columns that are kept, by their new names.

    Rows leave Python flat, those of a few pages at a time, and trees, which hold themselves, are let go before the next ones: what a task
    holds doesn't grow with its batches.
    """
    told = StructType.fromDDL(schema)
    kinds = [to_arrow_type(c.dataType) for c in told]
    names = [*kept.values(), *told.names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(start, PAGES_AT_ONCE)
                owner, found = [], []
                for k, values in enumerate(zip(*(some.column(c).to_pylist() for c in given), strict=True)):
                    for row in f(*values):
                        owner.append(k)
                        found.append(row)
                own = zip(zip(*found, strict=True), kinds, strict=True) if found else (([], t) for t in kinds)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(at) for c in kept), *(pa.array(v, t) for v, t in own)], names)
                gc.collect()

    columns = [StructField(new, pages.schema[old].dataType) for old, new in kept.items()]
    return spread(pages.select(*dict.fromkeys([*kept, *given]))).mapInArrow(read, StructType([*columns, *told.fields]))


def _exploded(pages: DataFrame, f, schema: str, content: str) -> DataFrame:
    """Rows of a parser that turns one page's content into a list of tuples, beside the page's other columns."""
    return rows_of(pages, f, schema, [content], {c: f"page_{c}" for c in pages.columns if c != content})


def _linked(pages: DataFrame, find: Callable[..., Iterable[tuple]], more: str = "") -> DataFrame:
    """The links of pages (url, content): page_url and the like, page_key (the page's own address, normalised), url (normalised) and what else find tells of a link behind its href.

    Addresses are normalised where the page is read: a task has one worker of Python, not another one for each column of addresses.
    """

    def read(content: str | bytes | None, at: str | None) -> Iterator[tuple]:
        own = normalized(at)
        return ((own, url, *told) for href, *told in find(content) if (url := normalized(href, at)))

    return rows_of(pages, read, f"page_key string, url string{more}", ["content", "url"], {c: f"page_{c}" for c in pages.columns if c != "content"})


def parse_feeds(feeds: DataFrame, now: dt.datetime) -> DataFrame:
    """Candidates of feeds (url, content), with page_url and pos."""
    return feed_candidates(_exploded(feeds, feed_entries, ENTRY, "content"), now)


def feed_candidates(rows: DataFrame, now: dt.datetime) -> DataFrame:
    """Candidates of feeds' raw entries, in batches or in a stream."""
    key = normalize_url(unwrap_redirect(F.col("url")), F.col("page_url"))
    return rows.select("page_url", "pos", key.alias("url"), key.alias("key"), F.lit("feed").alias("via"), "title", "summary", normalize_url(F.col("image"), F.col("url")).alias("image_url"), parse_datetime(F.col("published"), now).alias("published_at"), "author", "tags").where("url IS NOT NULL")


#: How links begin that lead to no page.
NO_PAGE = ("#", "mailto:", "tel:", "javascript:")


def parse_listings(pages: DataFrame, article_patterns: list[str] | None = None, exclude: list[str] | None = None, wanted: Column | None = None) -> DataFrame:
    """Candidates of listing pages (url, content): links of the same site that look like articles, each once with its longest anchor text.

    What an article's address looks like may also be told by `wanted`, of url and the pages' other columns as page_....
    """
    rows = _linked(pages, lambda c: ((x["href"], i, x["text"]) for i, x in enumerate(H.links(c)) if not x["href"].lower().startswith(NO_PAGE)), ", pos int, text string")
    rows = rows.where(same_site(F.col("url"), F.col("page_url")) & (match_key(F.col("url")) != match_key(F.col("page_key"))))
    if exclude:
        rows = rows.where(~excluded(F.col("url"), exclude))
    rows = rows.where(wanted if wanted is not None else excluded(F.col("url"), article_patterns) if article_patterns else looks_like_article(F.col("url")))
    title = F.when(F.length("text") > 15, F.col("text"))
    found = rows.groupBy("page_url", "url").agg(F.min("pos").alias("pos"), F.max_by(title, F.struct(F.length(title), -F.col("pos"))).alias("title"))
    nothing = {c: F.lit(None).cast(t) for c, t in (("summary", "string"), ("image_url", "string"), ("published_at", "timestamp"), ("author", "string"), ("tags", "array<string>"))}
    return found.select("page_url", "pos", "url", F.col("url").alias("key"), F.lit("listing").alias("via"), "title", *(v.alias(k) for k, v in nothing.items()))


def advertised_feeds(pages: DataFrame) -> DataFrame:
    """page_url, url of the feeds that pages advertise, without comment feeds."""

    def find(content):
        return [(n.attrs.get("href", ""),) for n in H.tree(content).all("link") if "alternate" in n.attrs.get("rel", "").lower() and re.search(r"(?i)application/(rss|atom)\+xml|application/(rdf\+)?xml|text/xml", n.attrs.get("type", ""))]

    return _linked(pages, find).select("page_url", "url").where("NOT contains(url, 'comments')").distinct()


def parse_sitemaps(files: DataFrame, now: dt.datetime) -> DataFrame:
    """page_url, kind (url, sitemap), loc, lastmod of sitemaps (url, content)."""
    return _exploded(files, sitemap_rows, "kind string, loc string, lastmod string", "content").withColumn("lastmod", parse_datetime(F.col("lastmod"), now))


def crawled(start: list[str], fetch, now: dt.datetime, since: dt.datetime | None = None, patterns: list[str] | None = None, most: int = 200) -> DataFrame | None:
    """Pages of sitemaps, breadth first: fetch(urls) gives a DataFrame (url, content). Child sitemaps of earlier years than `since` are left out."""
    seen, frontier, found = set(), list(dict.fromkeys(start)), None
    while frontier and len(seen) < most:
        batch = [u for u in frontier if u not in seen][: most - len(seen)]
        seen.update(batch)
        rows = parse_sitemaps(fetch(batch), now)
        pages = rows.where("kind = 'url'")
        if since:
            pages = pages.where(F.col("lastmod").isNull() | (F.col("lastmod") >= F.lit(since)))
        if patterns:
            pages = pages.where(excluded(F.col("loc"), patterns))
        found = pages if found is None else found.unionByName(pages)
        children = rows.where((F.col("kind") == "sitemap") & ~F.col("loc").isin(sorted(seen)))
        if since:
            year = F.regexp_extract("loc", r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
            children = children.where((year == "") | (year >= str(since.year)))
        frontier = [r["loc"] for r in children.select("loc").distinct().orderBy("loc").limit(most).collect()]
    return found


def sitemaps_in_robots(robots: Column) -> Column:
    """The sitemaps that a robots.txt names."""
    lines = F.filter(F.split(robots, r"\r?\n"), lambda x: F.lower(x).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))), lambda x: x != "")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, if they come in fewer: a small file is one task otherwise. Larger input isn't moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Tasks for each core where rows are dealt out.
TASKS_A_CORE = 4


def dealt(rows: DataFrame) -> DataFrame:
    """rows, narrow ones that pages are made of, in even parts over all cores: a file of few row groups is as many busy tasks, however many partitions it is read in."""
    return rows if rows.isStreaming else rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def extract_articles(pages: DataFrame, now: dt.datetime, selector: str | None = None, *raw: str) -> DataFrame:
    """Articles of pages (url, content): Python reads the markup once, in order of trust; of each chain the first value that holds up counts. Raw values may be asked for too.

    Pictures count that aren't logos or the like, dates that are plausible, addresses of the same site, and of the ways to the
    text (a known container, the page's state, the densest element, the structured body) the first with a paragraph of prose.
    """

    names = StructType.fromDDL(H.ARTICLE_SCHEMA).names

    def read(url: str, content: str | bytes | None) -> Iterator[tuple]:
        a = H.article(content, selector, lambda text: parsed(text, now) is not None)
        a["canonical"], a["images"] = ([u for x in a[k] if (u := normalized(x, url))] for k in ("canonical", "images"))
        a["dates"], a["modified"] = ([at.isoformat() for x in a[k] if (at := parsed(x, now))][:1] for k in ("dates", "modified"))
        yield tuple(a[c] for c in names)

    one = lambda values: F.get(values, F.lit(0))
    e = rows_of(pages, read, H.ARTICLE_SCHEMA, ["url", "content"], {"url": "url"})
    e = e.withColumn("title", F.nullif(headline(one(F.col("titles")), F.col("site_name")), F.lit(""))).withColumn("published_at", F.to_timestamp(one(F.col("dates"))))
    # a coalesce stops at what it has, so texts behind the first that gives an intro aren't looked at
    e = e.withColumn("intro", F.aggregate("stories", F.lit(None).cast("string"), lambda got, s: F.coalesce(got, intro(s, F.col("title")))))
    return e.select(
        "url",
        one(F.filter("canonical", lambda u: same_site(u, F.col("url")))).alias("canonical_url"),
        "title",
        "intro",
        F.nullif(clean_text(F.col("description")), F.lit("")).alias("description"),
        one(F.filter("images", lambda u: ~shows_nothing(u))).alias("image_url"),
        "published_at",
        F.to_timestamp(one(F.col("modified"))).alias("modified_at"),
        "author",
        "section",
        first_distinct(F.col("tags"), 25).alias("keywords"),
        "site_name",
        (F.col("is_object") | F.col("is_dated") | (F.lower(F.coalesce("og_type", F.lit(""))) == "article") | (F.col("has_article") & F.col("published_at").isNotNull() & F.col("intro").isNotNull())).alias("is_article"),
        *raw,
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """The columns of pages but the content, and title, the title as it is written, paragraphs, links and pictures of each."""
    names = StructType.fromDDL(H.FACTS_SCHEMA).names

    def read(content: str | bytes | None) -> Iterator[tuple]:
        told = H.facts(content)
        yield tuple(told[c] for c in names)

    return rows_of(pages, read, H.FACTS_SCHEMA, ["content"], {c: c for c in pages.columns if c != "content"})


def link_shapes(pages: DataFrame, top: int = 15) -> DataFrame:
    """The commonest forms of the different links within pages' own sites, with two examples each."""
    rows = _linked(pages, lambda c: ((x["href"],) for x in H.links(c))).where(same_site(F.col("url"), F.col("page_url"))).select("page_url", "url").distinct()
    shape = F.concat(host_of(F.col("url")), path_shape(F.col("url")))
    return rows.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.array_compact(F.array(F.min("url"), F.nullif(F.max("url"), F.min("url")))).alias("examples")).orderBy(F.desc("n"), "shape").limit(top)


def repeated_blocks(pages: DataFrame, least: int = 3) -> DataFrame:
    """page_url, block (tag and classes), n and the first one's text, of blocks that stand `least` times or more under one parent: where a listing's entries are."""
    return _exploded(pages, lambda c: H.repeated(c, least), "block string, n int, example string", "content")


def merged_candidates(found: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """One candidate per key: feed entries before bare links, then by pos; a missing title comes from the others."""
    order = Window.partitionBy(*by).orderBy(F.col("via") != "feed", "pos", "url")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = found.withColumn("title", F.first("title", ignorenulls=True).over(every)).withColumn("_n", F.row_number().over(order))
    return rows.where("_n = 1").drop("_n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (url, content): the path stands for the address."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")


