"""Sources, ingest and state over pages, feeds and logs that are written of the test tables' rows, with what must come out as SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidewire import config
from tidewire.functions import html as H
from tidewire.functions import keywords as KW
from tidewire.operators import ingest as I
from tidewire.operators import jobs as J
from tidewire.operators import listing as L
from tidewire.operators import outputs, runs
from tidewire.operators import state as S
from tidewire.plans.registry import query
from tidewire.plans.rules import TOPICS
from tidewire.plans.stand_ins import JOBS, NOW, STORIES, articles, jobs, sources, table
from tidewire.plans.texts import _NUMBER_SHAPE, FAR, NUMBER, K, P, by, docs, joined
from tidewire.schemas import SCHEMAS
from tidewire.session import shared_dir
from tidewire.sources import apis, boards
from tidewire.sources import pages as PG


def null(kind: str):
    return F.lit(None).cast(kind)


# feeds, listings, sitemaps


def _RFC():
    return F.concat(F.date_format(F.timestamp_seconds(F.lit(1704067200) + K() * 60), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def _ISO():
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + K() * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(
    "feed_candidates",
    """SELECT 'https://www.example.com/n/' || doc_id || '/' AS url, 'Story & ' || doc_id AS title, 'Text ' || doc_id || '.' AS summary, 'Ann B' || doc_id AS author, CASE WHEN doc_id % 4 < 2 THEN lang ELSE '' END AS tags, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS published_at,
'https://img.example.com/' || ['content', 'thumb', 'inline', ''][1 + doc_id % 4] || '/' || doc_id || '.jpg' AS image_url FROM documents WHERE doc_id % 4 < 3""",
)
def feed_candidates(spark, d):
    link, title = joined("https://www.example.com/n/", NUMBER(), "/?utm_source=feed"), joined("Story &amp;amp; ", NUMBER())
    image = lambda kind: joined("https://img.example.com/", kind, "/", NUMBER(), ".jpg")
    item = joined("<item><title>", title, "</title><link>", link, "</link><pubDate>", _RFC(), "</pubDate><dc:creator>Ann B", NUMBER(), "</dc:creator><category>", F.col("lang"), "</category><description>&lt;p&gt;Text ", NUMBER(), ".&lt;/p&gt;</description>")
    rss = lambda *media: joined('<rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>', item, *media, "</item><item><title>none</title></item></channel></rss>")
    thumb = joined('<media:thumbnail url="', image("thumb"), '"/>')
    atom = joined('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>', title, '</title><link rel="self" href="https://x.org/"/><link href="', link, '"/><updated>', _ISO(), "</updated><author><name>Ann B", NUMBER(), '</name></author><content type="html">&lt;img src="', image("inline"), '"&gt;&lt;p&gt;Text ', NUMBER(), ".&lt;/p&gt;</content></entry></feed>")
    body = by(4, rss(thumb, joined('<media:content url="', image("content"), '" medium="image"/>')), rss(thumb), atom, "<rss><channel><item>")
    feeds = docs(spark, d).withColumn("lang", F.coalesce("lang", F.lit(""))).select(joined("https://www.example.com/feed/", NUMBER()).alias("url"), body.alias("content"))
    return PG.parse_feeds(feeds, FAR).select("url", "title", "summary", "author", F.array_join("tags", ",").alias("tags"), "published_at", "image_url")


@query("reddit_feed", "SELECT 'https://www.reddit.com/r/x/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'Body ' || doc_id END AS summary, CASE WHEN doc_id % 2 = 1 THEN 'https://i.redd.it/' || doc_id || '.png' END AS image_url, 'u/m' || doc_id AS author FROM documents")
def reddit_feed(spark, d):
    inner = by(2, joined('&lt;div class="md"&gt;&lt;p&gt;Body ', NUMBER(), "&lt;/p&gt;&lt;/div&gt;&lt;a href=\"https://x.com/a\"&gt;[link]&lt;/a&gt;"), joined('&lt;img src="https://x.com/t.jpg"&gt;&lt;a href="https://i.redd.it/', NUMBER(), '.png"&gt;[link]&lt;/a&gt;'))
    atom = joined('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://www.reddit.com/r/x/', NUMBER(), '"/><author><name>/u/m', NUMBER(), '</name></author><content type="html">', inner, "</content></entry></feed>")
    return PG.parse_feeds(docs(spark, d).select(F.lit("https://www.reddit.com/r/x/.rss").alias("url"), atom.alias("content")), FAR).select("url", "summary", "image_url", "author")


@query("listing_candidates", "SELECT 'https://www.example.com/2024/1/' || doc_id AS url, CASE WHEN doc_id % 3 < 2 THEN 'The longest headline of ' || doc_id END AS title FROM documents")
def listing_candidates(spark, d):
    path = joined("/2024/1/", NUMBER())
    page = joined('<a href="', path, '#c">short</a><a href="', path, '">', by(3, joined("The longest headline of ", NUMBER()), joined("The <b>longest</b>  headline of ", NUMBER()), "short"), "</a>", '<a href="https://other.org/2024/1/1">The longest headline elsewhere</a><a href="/about">About us and all of our people</a><a href="/sports/2024/1/', NUMBER(), '">The longest headline of sports</a><a href="mailto:a@b.c">Write</a>')
    rows = docs(spark, d).select(F.lit("https://www.example.com/news").alias("url"), page.alias("content"))
    return PG.parse_listings(rows, exclude=["/sports/"]).select("url", "title")


@query("advertised_feeds", "SELECT 'https://www.example.com/' || doc_id || '/feed' AS url FROM documents WHERE doc_id % 2 = 0")
def advertised_feeds(spark, d):
    page = joined('<link rel="alternate" type="', by(2, "application/rss+xml", "text/html"), '" href="/', NUMBER(), '/feed"><link rel="alternate" type="application/atom+xml" href="/', NUMBER(), '/comments/feed">')
    return PG.advertised_feeds(docs(spark, d).select(F.lit("https://www.example.com/news").alias("url"), page.alias("content"))).select("url")


@query("link_shape_counts", f"SELECT 'www.example.com/news/' || {_NUMBER_SHAPE} AS shape, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'www.example.com/news/{{slug}}', count(*) FROM documents UNION ALL SELECT 'www.example.com/about', 1")
def link_shape_counts(spark, d):
    page = joined('<a href="/news/', NUMBER(), '">a</a><a href="news/a-long-name-', NUMBER(), '">b</a>', by(2, '<a href="/about">c</a><a href="https://other.org/x">d</a>', ""))
    return PG.link_shapes(docs(spark, d).select(F.lit("https://www.example.com/").alias("url"), page.alias("content"))).select("shape", "n")


@query("repeated_blocks", "SELECT 'https://a.com/' || doc_id AS page_url, 'li.job.open' AS block, CAST(3 + doc_id % 4 AS INT) AS n, 'Job ' || doc_id AS example FROM documents")
def repeated_blocks(spark, d):
    entry = joined("<li class='job  open'><b class='t'>Job</b> ", NUMBER(), "</li>")
    page = joined("<div class='a'></div><div class='a'></div><ul>", F.array_join(F.array_repeat(entry, (3 + K() % 4).cast("int")), "<li>x</li>"), "</ul>")
    return PG.repeated_blocks(docs(spark, d).select(joined("https://a.com/", NUMBER()).alias("url"), page.alias("content"))).select("page_url", "block", "n", "example")


_CONFIG = {"defaults": {}, "sources": [{"slug": f"src{k}", "name": f"Source {k}", "feeds": "https://a.com/f"} | ({"cannot_scrape": "closed"} if k % 5 == 0 else {}) | ({"only_in_topic": "club"} if k % 5 == 1 else {}) for k in range(12)]}


def _config():
    return config.load(_CONFIG, {"categories": [{"slug": "club", "name": "Club"}]})


@query("status_listed", f"{STORIES} SELECT s.slug, count(a.id) AS total FROM sources s LEFT JOIN articles a ON a.source_id = s.id WHERE s.id < 12 AND s.id % 5 > 0 GROUP BY 1")
def status_listed(spark, d):
    return L.listed_status(L.source_status(articles(spark, d), sources(spark, d), NOW), _config().collectable(spark)).select("slug", "total")


@query("sidebar_sources", f"{STORIES} SELECT s.slug, s.name FROM sources s LEFT JOIN articles a ON a.source_id = s.id WHERE s.id >= 12 OR s.id % 5 > 1 GROUP BY 1, 2 HAVING count(a.id) > 0")
def sidebar_sources(spark, d):
    return L.sidebar_sources(L.offered_sources(articles(spark, d), sources(spark, d)), _config().left_out(spark)).select("slug", "name")


@query("sitemap_rows", "SELECT 'https://a.com/' || doc_id AS loc, CASE WHEN doc_id % 2 = 0 THEN 'url' ELSE 'sitemap' END AS kind, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) END AS lastmod FROM documents")
def sitemap_rows(spark, d):
    stamp = by(3, joined("<lastmod>", _ISO(), "</lastmod>"), "", "<lastmod>never</lastmod>")
    body = by(2, joined('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/', NUMBER(), "</loc>", stamp, "</url></urlset>"), joined("<sitemapindex><sitemap><loc>https://a.com/", NUMBER(), "</loc>", stamp, "</sitemap></sitemapindex>"))
    return PG.parse_sitemaps(docs(spark, d).select(F.lit("u").alias("url"), body.alias("content")), FAR).select("loc", "kind", "lastmod")


@query("sitemap_crawl", "SELECT 'https://a.com/2024/' || doc_id AS loc FROM documents WHERE doc_id % 20 > 9")
def sitemap_crawl(spark, d):
    """An index of twenty child sitemaps by year; those of the earlier year aren't fetched."""
    files = docs(spark, d).groupBy((K() % 20).alias("b")).agg(F.array_join(F.collect_list(joined("<url><loc>https://a.com/", F.when(K() % 20 > 9, "2024").otherwise("2023"), "/", NUMBER(), "</loc></url>")), "").alias("urls"))
    files = files.select(joined("https://a.com/s", F.when(F.col("b") > 9, "2024").otherwise("2023"), "-", F.col("b").cast("string"), ".xml").alias("url"), joined("<urlset>", F.col("urls"), "</urlset>").alias("content"))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.com/s{2024 if b > 9 else 2023}-{b}.xml</loc></sitemap>" for b in range(20)) + "</sitemapindex>"
    files = files.unionByName(spark.createDataFrame([("https://a.com/i.xml", index)], "url string, content string"))
    return PG.crawled(["https://a.com/i.xml"], lambda urls: files.where(F.col("url").isin(urls)), FAR, since=dt.datetime(2024, 1, 1, tzinfo=dt.UTC), most=12).select("loc")


@query("reddit_posts", "SELECT 'https://www.reddit.com/r/x/' || doc_id || '/' AS url, 'Post & ' || doc_id AS title, CASE WHEN doc_id % 6 = 0 THEN 'Hi ' || doc_id END AS summary, CASE WHEN doc_id % 6 = 1 THEN 'https://i.redd.it/' || doc_id || '.png' END AS image_url, CASE WHEN doc_id % 6 < 2 THEN 'u/m' END AS author FROM documents WHERE doc_id % 6 < 3")
def reddit_posts(spark, d):
    data = F.struct(joined("/r/x/", NUMBER(), "/").alias("permalink"), by(6, *[joined("Post &amp; ", NUMBER())] * 5, " ").alias("title"), by(6, "https://x.com/", joined("https://i.redd.it/", NUMBER(), ".png"), "https://x.com/").alias("url"), by(6, joined("<div class='md'>Hi ", NUMBER(), "</div>"), "").alias("selftext_html"), by(6, "m", "m", "[deleted]").alias("author"), F.lit(1.7e9).alias("created_utc"), (K() % 6 == 3).alias("over_18"), F.when(K() % 6 == 4, "moderator").alias("removed_by_category"))
    child = F.struct(F.lit("t3").alias("kind"), data.alias("data"))
    content = F.to_json(F.struct(F.struct(F.array(child, F.struct(F.lit("t1").alias("kind"), data.alias("data"))).alias("children")).alias("data")))
    return apis.parse_posts(docs(spark, d).select(F.lit("u").alias("url"), content.alias("content")), "x").select("url", "title", "summary", "image_url", "author")


# job boards


def _KEY():
    return P().cast("string")


def _DAY():
    return F.date_add(F.lit(dt.date(2024, 1, 1)), (P() % 300).cast("int"))


def _board(spark, d, kind, *parts, **options):
    rows = PG.dealt(table(spark, d, "part")).select(joined("https://b.example.com/list/", _KEY()).alias("url"), joined(*parts).alias("content"))
    return boards.parse_board(rows, kind, **options)


@query("board_table", "SELECT 'https://b.example.com/job_detail/' || p_partkey AS url, p_name AS title, p_brand AS employer, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS open_date, CASE WHEN p_partkey % 2 = 0 THEN 'Open until filled' END AS close_note, 'https://b.example.com/' || p_partkey || '.pdf' AS pdf_url FROM part WHERE p_partkey % 5 > 0")
def board_table(spark, d):
    row = joined("<table><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table><table id='example'><tr><th>Title</th></tr><tr><td><a href='/x'>", F.col("p_name"), "</a> Category: none</td><td><strong>", F.col("p_brand"), "</strong> more</td><td>", F.date_format(_DAY(), "M/d/yyyy"), "</td><td>", by(2, "Open until filled", "12/31/2024", key=P()), "</td><td>", F.when(P() % 5 == 0, "Closed").otherwise("Open"), "</td><td><a href='/application.pdf'>Application</a><a href='/", _KEY(), ".pdf'>pdf</a><a href='/job_detail/", _KEY(), "'>detail</a></td></tr></table>")
    return _board(spark, d, "job_table", row).select("url", "title", "employer", F.col("open_date").cast("string").alias("open_date"), "close_note", "pdf_url")


@query("board_pdfs", "SELECT u AS url, t || p_name AS title, CASE WHEN p_partkey % 5 < 2 THEN p_brand ELSE 'Islands' END AS employer FROM part, LATERAL (VALUES ('https://b.example.com/a%20' || p_partkey || '.pdf', ''), ('https://f.ucarecd.net/' || p_partkey || '/', 'Applications clerk '), ('https://f.ucarecdn.com/' || p_partkey, 'Second '), ('https://b.example.com/' || p_partkey || '.PDF?x=1', 'Clerk of applications ')) AS v(u, t) WHERE t <> 'Applications clerk '")
def board_pdfs(spark, d):
    """Openings under headings that name an employer or none, beside menus, sidebars, forms and notices."""
    link = lambda path, text: joined("<a href='", path, "'>", text, "</a>")
    menu = lambda start, end: joined(start, "<h2>Menu job announcements</h2>", link(joined("/nav", _KEY(), ".pdf"), "Harbor menu"), end)
    file, named = joined("/a ", _KEY(), ".pdf#page=2"), F.col("p_name")
    heading = by(5, joined(F.col("p_brand"), " Job Announcements"), joined(F.col("p_brand"), "  job announcement"), "Other job announcements", "RCUOG Job Announcements", "Job announcements", key=P())
    openings = [link(file, named), link(file, "Again"), link(joined("https://f.ucarecd.net/", _KEY(), "/"), joined("Applications clerk ", named)), link(joined("https://f.ucarecdn.com/", _KEY()), joined("Second ", named)), link(joined("/", _KEY(), ".PDF?x=1"), joined("Clerk of applications ", named))]
    notices = [link(f"/n{i}.pdf", t) for i, t in enumerate(("Application form", "The employment application", "ab", "AmeriCorps job application", "AmeriCorps application 2024", "View all", "Amendment 2", "Recruitment flyer"))]
    page = joined("<body>", menu("<nav>", "</nav>"), menu("<div id='leftCol'>", "</div>"), "<main>", menu("<ul class='a sideNav'><li>", "</li></ul>"), "<h2>", heading, "</h2>", *openings, *notices, link("/h.html", "Page of it"), link("https://ucarecd.net.example.org/x", "Elsewhere"), "</main>", link("/outside.pdf", "Outside"), "</body>")
    return _board(spark, d, "pdf_links", page, employer="Islands").select("url", "title", "employer")


@query("board_federal", "SELECT 'https://b.example.com/jobs/' || p_partkey AS url, p_name AS title, p_brand AS employer, p_type AS location, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS close_date FROM part")
def board_federal(spark, d):
    row = joined("<table><tr><td><a href='/help'>?</a><a href='/jobs/", _KEY(), "'>", F.col("p_name"), "</a></td><td>", F.col("p_type"), "</td><td>GS-7</td><td>", F.col("p_brand"), "</td><td>", F.date_format(_DAY(), "MMM d, yyyy"), "</td><td>", F.date_format(_DAY(), "MMMM d, yyyy"), "</td></tr><tr><td><a href='/jobs/0'>x</a></td></tr></table>")
    return _board(spark, d, "federal_table", row).select("url", "title", "employer", "location", F.col("close_date").cast("string").alias("close_date"))


@query("board_cards", "SELECT 'https://b.example.com/v.php?jobid=' || p_partkey AS url, p_name AS title, p_brand AS employer, '$' || p_size || '.00 per hour' AS pay, p_type AS location FROM part")
def board_cards(spark, d):
    card = joined("<div class='job-card new'><h3><a href='/v.php?k=1&amp;jobid=", _KEY(), "&amp;z=2'>", by(2, "Featured ", "", key=P()), F.col("p_name"), "</a></h3><i class='fa fa-usd'></i> ", F.col("p_size").cast("string"), " hour <i class='fa fa-briefcase'></i> ", F.col("p_brand"), " <i class='fa fa-location-arrow'></i> ", F.col("p_type"), " <p>Words</p></div><div class='job-card'><h3>no link</h3></div>")
    return _board(spark, d, "cards", card).select("url", "title", "employer", "pay", "location")


@query("board_sections", "SELECT 'https://b.example.com/list/' || p_partkey || '#' || replace(p_name, ' ', '-') AS url, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '$' || p_size || '.00 per hour' END AS pay, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS open_date, 'Work ' || p_partkey || '.' AS description FROM part")
def board_sections(spark, d):
    page = joined("<h4>", F.col("p_name"), "</h4><p>Date posted: ", F.date_format(_DAY(), "MMMM d, yyyy"), "</p>", by(2, joined("<p>Pays $", F.col("p_size").cast("string"), ".00 per hour</p>"), "<p>Unpaid</p>", key=P()), "<p>Job description: Work ", _KEY(), ".</p><p>Submit Application</p>")
    return _board(spark, d, "sections", page).select("url", "title", "pay", F.col("open_date").cast("string").alias("open_date"), "description")


@query("board_portal", "SELECT 'https://b.example.com/postings/' || p_partkey AS url, p_name AS title, 'Islands, ' || p_brand AS employer, '012-' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS reference, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS open_date FROM part")
def board_portal(spark, d):
    col = lambda x: joined('<div class="job-title-text-wrap">', x, "</div>")
    page = joined('<div class="job-item job-item-posting"><div class="job-title-text-wrap"><h3><a href="/postings/', _KEY(), '">', F.col("p_name"), "</a></h3></div>", col(F.col("p_brand")), col(joined("012-", F.lpad((P() % 100).cast("string"), 2, "0"))), col(F.date_format(_DAY(), "MM/dd/yyyy")), "</div>")
    return _board(spark, d, "portal", page, employer="Islands").select("url", "title", "employer", "reference", F.col("open_date").cast("string").alias("open_date"))


@query("board_details", "SELECT 'https://b.example.com/' || p_partkey AS url, '$' || p_size || ' per hour' AS pay, p_type AS location, 'Do ' || p_name || '.' AS description, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS close_date FROM part")
def board_details(spark, d):
    page = joined("<table><tr><th>Salary range:</th><td>$", F.col("p_size").cast("string"), " per hour</td></tr></table><dl><dt>Work Location</dt><dd>", F.col("p_type"), "</dd><dt>Job Summary</dt><dd>Do ", F.col("p_name"), ".</dd><dt>Closing date</dt><dd>", F.date_format(_DAY(), "MM/dd/yyyy"), "</dd></dl>")
    return boards.detail_fields(PG.dealt(table(spark, d, "part")).select(joined("https://b.example.com/", _KEY()).alias("url"), page.alias("content"))).select("url", "pay", "location", "description", F.col("close_date").cast("string").alias("close_date"))


def _details(spark, d, kind, page, **known):
    """Postings that know some fields already, and what their pages add."""
    rows = PG.dealt(table(spark, d, "part")).select(joined("https://b.example.com/", _KEY()).alias("url"), page.alias("content"), *(v.alias(k) for k, v in known.items()))
    told = boards.posting_details(rows.select("url", "content"), kind)
    out = boards.with_details(rows.drop("content"), told, kind)
    return out.select(*(F.col(c).cast("string").alias(c) for c in out.columns))


_DATE = "CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR)"


@query("detail_items", "SELECT 'https://b.example.com/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'known' ELSE '$' || p_size END AS pay, p_type AS location, CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE 'Do ' || p_name END AS description, 'https://b.example.com/' || p_partkey || '.pdf' AS pdf_url FROM part")
def detail_items(spark, d):
    item = lambda name, value: joined("<div class='item'><div class='name-column'>", name, "</div><div class='name-entity'>", value, "</div></div>")
    text = F.when(P() % 3 == 0, "View the Job Announcement").otherwise(joined("Do ", F.col("p_name")))
    page = joined(item("Salary Range", joined("$", F.col("p_size").cast("string"))), item("Job Location", F.col("p_type")), item("Job Description", joined("<a href='/x.html'></a><a href='/", _KEY(), ".pdf'>", text, "</a>")), item("Other", "x"))
    return _details(spark, d, "job_table", page, pay=F.when(P() % 2 == 0, "known"), location=F.lit("Here"), description=F.lit("short"), pdf_url=null("string"))


@query("detail_labels", f"SELECT 'https://b.example.com/' || p_partkey AS url, '$' || p_size AS pay, p_brand AS employer, '2024-01-01' AS open_date, {_DATE} AS close_date, 'Do ' || p_name || '. And more.' AS description FROM part")
def detail_labels(spark, d):
    row = lambda name, value: joined("<tr><td class='job-label'>", name, "</td><td>", value, "</td></tr>")
    page = joined("<table>", row("Salary", joined("$", F.col("p_size").cast("string"))), row("Department", F.col("p_brand")), row("Open Date", "soon"), row("Close Date", F.date_format(_DAY(), "MM/dd/yyyy")), "</table><h2>Duties</h2><p>Not this.</p><h2> Summary </h2><div><p>Do ", F.col("p_name"), ".</p></div><h3>More</h3><p>And more.</p><h2>Next</h2><p>Nor this.</p>")
    return _details(spark, d, "federal_table", page, pay=F.lit("known"), employer=F.lit("x"), open_date=F.lit(dt.date(2024, 1, 1)), close_date=null("date"), description=null("string"))


@query("detail_headed", "SELECT 'https://b.example.com/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'Do ' || p_name || ' every day' ELSE 'A text that is longer than what the page of it has to say' END AS description FROM part")
def detail_headed(spark, d):
    page = joined("<div><h3>Other</h3><div><h3>Job: ", F.col("p_name"), "</h3><p>Do ", F.col("p_name"), "</p> every day</div></div>")
    return _details(spark, d, "cards", page, description=by(2, "Do", "A text that is longer than what the page of it has to say", key=P()))


@query("detail_table", f"SELECT 'https://b.example.com/' || p_partkey AS url, '$' || p_size AS pay, p_type AS location, CASE WHEN p_partkey % 2 = 0 THEN {_DATE} END AS close_date, CASE WHEN p_partkey % 2 = 1 THEN 'Open until filled' END AS close_note FROM part")
def detail_table(spark, d):
    row = lambda name, value: joined("<tr><th>", name, "</th><td>", value, "</td></tr>")
    page = joined("<table>", row("Pay Rate", joined("$", F.col("p_size").cast("string"))), row("Salary", "later"), row("Location of work", F.col("p_type")), row("Deadline", by(2, F.date_format(_DAY(), "MMMM d, yyyy"), "Open until filled", key=P())), "</table>")
    return _details(spark, d, "university", page, pay=null("string"), location=F.lit("Here"), close_date=null("date"), close_note=null("string"))


@query("federal_api", "SELECT 'https://f.example.com/' || p_partkey AS url, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Bureau' END AS employer, '$' || format('{:,.2f}', p_retailprice) || ' per hour' AS pay, 'Guam' AS location, CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS VARCHAR) AS open_date FROM part")
def federal_api(spark, d):
    s = lambda v, n: (F.lit(v) if isinstance(v, str) else v).alias(n)
    pay = lambda low, high, code: F.struct(s(low, "MinimumRange"), s(high, "MaximumRange"), s(code, "RateIntervalCode"))
    price = F.col("p_retailprice").cast("string")
    job = F.struct(s(joined(" ", F.col("p_name"), " "), "PositionTitle"), s(joined("https://f.example.com/", _KEY()), "PositionURI"), s(by(2, F.col("p_brand"), "", key=P()), "OrganizationName"), s("Bureau", "DepartmentName"), F.array(F.struct(s("Guam", "LocationName")), F.struct(s("Ohio", "LocationName"))).alias("PositionLocation"), F.array(pay("0", "0", "PA"), pay(price, price, "PH")).alias("PositionRemuneration"), s(joined(F.date_format(_DAY(), "yyyy-MM-dd"), "T00:00:00"), "PublicationStartDate"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(job.alias("MatchedObjectDescriptor"))).alias("SearchResultItems")).alias("SearchResult")))
    return apis.parse_usajobs(table(spark, d, "part").select(body.alias("content"))).select("url", "title", "employer", "pay", "location", F.col("open_date").cast("string").alias("open_date"))


@query("government_api", "SELECT 'https://g.example.com#announcement-' || p_partkey AS url, p_name AS title, p_brand AS employer, CASE WHEN p_partkey % 2 = 0 THEN '$' || format('{:,.2f}', p_size * 100.0) || ' to $' || format('{:,.2f}', p_retailprice * 10) ELSE 'Grade ' || p_size END AS pay, CASE WHEN p_partkey % 3 > 0 THEN 'Open until filled' END AS close_note FROM part")
def government_api(spark, d):
    text = lambda v: v.cast("string")
    fields = F.map_from_arrays(
        F.array(F.lit("announcement_Id"), F.lit("PositionTitle"), F.lit("Agency"), F.when(P() % 2 == 0, "MIN_SALARY").otherwise("salary_Range"), F.lit("max_salary"), F.lit("Closing_Date")),
        F.array(_KEY(), F.col("p_name"), F.col("p_brand"), F.when(P() % 2 == 0, text(F.col("p_size") * 100)).otherwise(joined("Grade ", text(F.col("p_size")))), text(F.col("p_retailprice") * 10), F.when(P() % 3 == 0, "2024-05-01").otherwise("")),
    )
    body = F.to_json(F.struct(F.array(fields).alias("results")))
    return apis.parse_portal(table(spark, d, "part").select(body.alias("content")), "https://g.example.com", "https://g.example.com/api").select("url", "title", "employer", "pay", "close_note")


@query("paired_postings", "SELECT CASE WHEN p_partkey % 4 < 3 THEN 'portal/' ELSE 'file/' END || p_partkey AS url, CASE WHEN p_partkey % 4 IN (0, 1, 3) THEN 'file/' || p_partkey END AS pdf_url FROM part")
def paired_postings(spark, d):
    """By number, by a title of its own, without a file, and a file without a posting."""
    c = "url string, title string, pdf_url string, reference string"
    thousands = F.floor(P() / 1000).cast("string")
    number, kind = F.concat(F.lpad((P() % 1000).cast("string"), 3, "0"), F.lit("-"), F.when(F.length(thousands) < 2, F.concat(F.lit("0"), thousands)).otherwise(thousands)), P() % 4
    part = table(spark, d, "part")
    portal = part.where(kind < 3).select(joined("portal/", _KEY()).alias("url"), joined("Clerk ", F.when(kind == 1, _KEY()).otherwise(F.lit("of many"))).alias("title"), null("string").alias("pdf_url"), number.alias("reference"))
    files = part.where(kind != 2).select(joined("file/", _KEY()).alias("url"), F.when(kind == 0, joined(number, " Whatever")).when(kind == 1, joined("CLERK  ", _KEY(), " (Amendment 1)")).otherwise(joined("Cook ", _KEY())).alias("title"), joined("file/", _KEY()).alias("pdf_url"), null("string").alias("reference"))
    return J.paired_with_pdfs(spark.createDataFrame([], c).unionByName(portal).unionByName(files)).select("url", "pdf_url")


@query("details_to_read", f"{JOBS} SELECT url FROM jobs WHERE id % 3 > 0 AND id % 4 > 0 ORDER BY id LIMIT 25")
def details_to_read(spark, d):
    listed = jobs(spark, d).select("url", F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.col("url")).alias("detail_url"))
    stored = jobs(spark, d).select("url", F.when(F.col("id") % 4 == 0, F.lit(NOW)).alias("detail_fetched_at"))
    return J.needs_detail(listed, stored, 25).select("url")


# ingest and state


def _sources(spark, d):
    s = sources(spark, d)
    return s.select("id", "name", F.array().cast("array<string>").alias("categories"), F.array(F.lit("FR")).alias("exclude_sections"), (F.col("id") % 5 == 0).alias("require_place"), (F.col("id") % 7 == 6).alias("feed_only"), F.lit(10).alias("max_age_days"), F.lit(False).alias("undated"), F.lit(False).alias("vouching"), null("string").alias("only_in_topic"))


def _candidates(spark, d):
    i = F.col("id")
    return articles(spark, d).select("source_id", i.alias("pos"), "url", F.col("url").alias("key"), F.when(i % 3 == 0, "feed").otherwise("listing").alias("via"), F.when(i % 3 == 0, F.col("title")).alias("title"), F.col("intro").alias("summary"), "image_url", "published_at", null("string").alias("author"), F.array("section").alias("tags"))


_PLACE = r"regexp_matches(replace(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(intro, ''))), 'ß', 's') || ' ' || lower(url) || ' ' || section, '\bthe\b|\btion\w*')"


@query("prefiltered", f"{STORIES} SELECT id, CASE WHEN section = 'fr' THEN 'excluded section: fr' WHEN source_id % 5 = 0 AND id % 3 = 0 AND title IS NOT NULL AND NOT {_PLACE} THEN 'not about the place' END AS reason FROM articles")
def prefiltered(spark, d):
    found = _candidates(spark, d).withColumn("title", F.col("title"))
    return I.prefiltered(found, _sources(spark, d), ("the", "tion*")).select(F.col("pos").alias("id"), "reason")


@query("place_mentions", f"{STORIES} SELECT id, {_PLACE} AS about FROM articles")
def place_mentions(spark, d):
    from tidewire.functions.text import fold

    text = fold(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("intro", F.lit("")), "url", "section"))
    return articles(spark, d).select("id", KW.mentions(text, ("the", "tion*")).alias("about"))


@query(
    "draft_outcomes",
    f"""{STORIES}, a AS (SELECT *, id % 3 = 0 AS feed, id % 11 AS code, least(published_at, TIMESTAMP '2024-02-01 12:00:00') AS seen FROM articles),
s AS (SELECT id, CASE WHEN source_id % 7 = 6 AND feed THEN NULL WHEN code = 1 AND feed AND title IS NOT NULL THEN NULL WHEN code = 1 THEN 'failed: HTTP 403' WHEN code = 2 THEN 'throttled: asked to slow down' WHEN code = 3 THEN 'rejected: gone (404)' WHEN code = 4 THEN 'failed: HTTP 500' WHEN code = 5 THEN 'rejected: not HTML (image/png)' WHEN code = 6 AND NOT feed THEN 'rejected: not an article page' END AS f,
CASE WHEN coalesce(CASE WHEN code IN (0, 6, 7, 8, 9, 10) AND NOT (source_id % 7 = 6 AND feed) THEN 'Page ' || id END, CASE WHEN feed THEN title END, '') = '' THEN 'failed: no headline found' WHEN NOT feed AND seen < TIMESTAMP '2024-01-22 12:00:00' THEN 'rejected: older than 10 days' WHEN section = 'fr' THEN 'rejected: excluded section: fr' ELSE 'ok' END AS c FROM a WHERE source_id % 5 > 0)
SELECT id, coalesce(f, c) AS outcome FROM s""",
)
def draft_outcomes(spark, d):
    i = F.col("id")
    code = i % 11
    a = articles(spark, d)
    extracted = {"canonical_url": null("string"), "title": joined("Page ", i.cast("string")), "intro": null("string"), "description": null("string"), "image_url": null("string"), "published_at": null("timestamp"), "author": null("string"), "section": null("string"), "keywords": null("array<string>"), "site_name": null("string"), "is_article": code != 6}
    log = a.select("url", F.get(F.array(*map(F.lit, (200, 403, 429, 404, 500))), F.when(code < 5, code).otherwise(0).cast("int")).alias("http_status"), F.lit(False).alias("robots"), F.when(code == 5, "image/png").otherwise("text/html").alias("content_type"), F.col("url").alias("page_url"), *(v.alias(k) for k, v in extracted.items()))
    found = _candidates(spark, d).where("source_id % 5 > 0")
    told = I.drafts(found, log, _sources(spark, d), TOPICS, (), NOW)
    return told.select(F.col("pos").alias("id"), F.concat_ws(": ", "status", "reason").alias("outcome"))


@query("pending_pages", f"{STORIES} SELECT id FROM articles WHERE (source_id % 2 = 0 AND id % 5 = 0) OR (source_id % 2 > 0 AND id % 5 = 1)")
def pending_pages(spark, d):
    a = articles(spark, d).select("id", "source_id")
    read = a.where("source_id % 2 > 0").select("source_id")
    return I.pending_merged(a.where("id % 5 = 0"), a.where("source_id % 2 > 0 AND id % 5 = 1"), read).select("id")


@query("rebylined", f"{STORIES} SELECT id, 'Ann B' || id AS author FROM articles a WHERE id % 3 < 2")
def rebylined(spark, d):
    i = F.col("id")
    name = joined("Ann B", i.cast("string"))
    rows = articles(spark, d).select("id", "source_id", by(3, joined(name, ", Src", F.col("source_id").cast("string")), joined(name, " | Webmaster"), name, key=i).alias("author"))
    return I.rebylined(rows, sources(spark, d)).select("id", "author")


@query("scripted_pages", "SELECT doc_id, doc_id % 3 < 2 AS scripted FROM documents")
def scripted_pages(spark, d):
    from tidewire.functions.text import _udf

    page = by(3, joined("<p>Please enable JavaScript, reader ", NUMBER(), "</p>"), "<div id=app></div><script src=a.js></script>", joined("<p>", F.lit("A page with words of its own. " * 9), NUMBER(), "</p>"))
    return docs(spark, d).select("doc_id", _udf(H.needs_javascript, "boolean")(page).alias("scripted"))


@query("board_pages", "SELECT 'https://b.example.com/' || k AS url FROM (SELECT DISTINCT p_partkey % 7 AS k FROM part)")
def board_pages(spark, d):
    """Pages that link to the next one, and to the first again."""
    rows = table(spark, d, "part").select((P() % 7).alias("k")).distinct()
    at = lambda k: joined("https://b.example.com/", k.cast("string"))
    pages = rows.select(at(F.col("k")).alias("url"), joined("<ul class='pagination'><li><a href='/0'>1</a></li></ul>", F.when(F.col("k") < 6, joined("<a rel='next' href='", at(F.col("k") + 1), "'>more</a>")).otherwise("")).alias("content"))
    return boards.board_pages(["https://b.example.com/0"], lambda urls: pages.where(F.col("url").isin(urls)))[0].select("url")


@query("reclassified", f"{STORIES} SELECT id, 'rest' AS topics FROM articles WHERE source_id % 3 = 0 AND array_to_string(categories, ',') <> 'rest' UNION ALL SELECT id, 'club' FROM articles WHERE source_id % 3 = 1 AND array_to_string(categories, ',') <> 'club'")
def reclassified(spark, d):
    """Sources of one topic, and those whose stories fall to the last resort; the others have no topics to lose."""
    rows = articles(spark, d).where("source_id % 3 < 2").withColumns({"keywords": null("string"), "url": F.lit("https://x.com/")})
    s = sources(spark, d).select("id", F.array().cast("array<string>").alias("forced"), F.when(F.col("id") % 3 == 1, "club").alias("only"))
    topics = [KW.Topic("none", "None", ("zzzzzz",)), KW.Topic("rest", "Rest", ("zzzzzz",), fallback=True)]
    return KW.reclassified(rows, topics, s).select("id", F.array_join("categories", ",").alias("topics"))


@query("confined", f"{STORIES} SELECT id, CASE WHEN source_id % 4 = 0 THEN 'club' ELSE array_to_string(categories, ',') END AS topics FROM articles")
def confined(spark, d):
    s = sources(spark, d).select("id", F.when(F.col("id") % 4 == 0, "club").alias("only_in_topic"))
    return S.confined(articles(spark, d), s).select("id", F.array_join("categories", ",").alias("topics"))


@query("images_removed", f"{STORIES} SELECT id, CASE WHEN n < 3 THEN image_url END AS image_url FROM (SELECT *, count(*) OVER (PARTITION BY source_id, image_url) AS n FROM articles)")
def images_removed(spark, d):
    a = articles(spark, d)
    generic = a.where("image_url IS NOT NULL").groupBy("source_id", "image_url").agg(F.count("*").alias("n")).where("n >= 3")
    return I.without_images(a, generic.union(generic)).select("id", "image_url")


@query(
    "stored_stories",
    f"""{STORIES}, old AS (SELECT id, url, CASE WHEN id % 4 = 0 THEN 'x' END AS alias FROM articles WHERE id % 3 = 0), new AS (SELECT * FROM articles WHERE id % 3 = 1)
SELECT url, id, CASE WHEN alias IS NULL AND id % 2 = 0 THEN url || '?old' ELSE alias END AS discovered_url FROM old UNION ALL SELECT url, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY source_id, id), CASE WHEN id % 2 = 0 THEN url || '?old' END FROM new""",
)
def stored_stories(spark, d):
    """Of every three stories one is stored, one is new and comes twice, and the stored ones come again, some under an alias."""
    i, a = F.col("id"), articles(spark, d)
    empty = spark.createDataFrame([], SCHEMAS["articles"])
    old = empty.unionByName(a.where("id % 3 = 0").withColumn("discovered_url", F.when(i % 4 == 0, "x")), allowMissingColumns=True).select(*empty.columns)
    alias = F.when(i % 2 == 0, joined(F.col("url"), "?old"))
    new = a.where("id % 3 < 2").select("source_id", i.alias("pos"), F.col("url").alias("key"), F.lit("ok").alias("status"), null("string").alias("reason"), "url", "title", "published_at", alias.alias("discovered_url"))
    again = new.where("pos % 3 = 1").withColumns({"pos": F.col("pos") + 1_000_000_000, "discovered_url": F.lit("later")})
    return S.stored_articles(old, new.unionByName(again), NOW)[0].select("url", "id", "discovered_url")


@query("bucket_upsert", f"{STORIES} SELECT id, url, CASE WHEN id % 7 = 0 THEN 'changed' ELSE title END AS title FROM articles WHERE id % 5 > 0 OR id % 7 = 0 UNION ALL SELECT id + 1000000000, url || '/new', title FROM articles WHERE id % 10 = 3")
def bucket_upsert(spark, d):
    """Four of five stories are stored; then every seventh comes changed or new, and every tenth gets a sister of its own, as two merges."""
    i, a = F.col("id"), articles(spark, d).select("id", "url", "title")
    table = S.BucketedTable(spark, f"{shared_dir(spark)}/bucket-upsert-{uuid.uuid4().hex}", "id long, url string, title string", "url", 16)
    table.write(a.where("id % 5 > 0"))
    put = lambda old, new: S.upserted(old, new, "url")
    table.merge(a.where("id % 7 = 0").withColumn("title", F.lit("changed")), put)
    table.merge(a.where("id % 10 = 3").select((i + 1_000_000_000).alias("id"), F.concat("url", F.lit("/new")).alias("url"), "title"), put)
    return table.read()


@query("duplicate_stories", f"{STORIES} SELECT url, 'duplicate' AS reason FROM articles WHERE id % 3 = 0 AND (id % 2 = 1 OR id % 4 = 0) UNION ALL SELECT url, 'duplicate' FROM articles WHERE id % 3 = 1")
def duplicate_stories(spark, d):
    i, a = F.col("id"), articles(spark, d)
    empty = spark.createDataFrame([], SCHEMAS["articles"])
    old = empty.unionByName(a.where("id % 3 = 0").withColumn("discovered_url", F.when(i % 4 == 0, "x")), allowMissingColumns=True).select(*empty.columns)
    new = a.where("id % 3 < 2").select("source_id", i.alias("pos"), F.col("url").alias("key"), F.lit("ok").alias("status"), null("string").alias("reason"), "url", "title", "published_at", F.when(i % 2 == 0, joined(F.col("url"), "?old")).alias("discovered_url"))
    again = new.where("pos % 3 = 1").withColumn("pos", F.col("pos") + 1_000_000_000)
    return S.stored_articles(old, new.unionByName(again), NOW)[1].select("url", "reason")


_RUNS = f"{STORIES}, r AS (SELECT source_id, count(*) AS candidates, sum(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) AS new_articles, sum(CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END) AS failed FROM articles GROUP BY 1)"


def _runs(spark, d):
    a = articles(spark, d)
    empty = spark.createDataFrame([], SCHEMAS["scrape_runs"])
    log = runs.opened(runs.opened(empty, a.select("source_id"), NOW), a.where("source_id % 2 = 0").select("source_id"), NOW + dt.timedelta(hours=1))
    i = F.col("id")
    results = a.groupBy("source_id").agg(F.count("*").alias("candidates"), F.sum((i % 4 == 0).cast("int")).alias("new_articles"), F.sum((i % 4 == 1).cast("int")).alias("failed"), F.when(F.count("*") > 50, "slow").alias("error"))
    return runs.closed(log, results, NOW + dt.timedelta(hours=2))


@query("run_log", f"{_RUNS}, n AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS id FROM r), m AS (SELECT source_id, (SELECT count(*) FROM r) + row_number() OVER (ORDER BY source_id) AS id FROM r WHERE source_id % 2 = 0) SELECT n.id, n.source_id, CASE WHEN n.source_id % 2 > 0 THEN candidates ELSE 0 END AS candidates, n.source_id % 2 > 0 AS ended FROM n JOIN r ON n.source_id = r.source_id UNION ALL SELECT m.id, m.source_id, candidates, true FROM m JOIN r ON m.source_id = r.source_id")
def run_log(spark, d):
    return _runs(spark, d).select("id", "source_id", F.col("candidates").cast("long").alias("candidates"), F.col("finished_at").isNotNull().alias("ended"))


@query("run_totals", f"{_RUNS} SELECT TIMESTAMP '2024-02-01 12:00:00' AS started_at, count(*) AS sources, CAST(sum(CASE WHEN source_id % 2 > 0 THEN new_articles ELSE 0 END) AS BIGINT) AS new_articles, CAST(sum(CASE WHEN source_id % 2 > 0 THEN failed ELSE 0 END) AS BIGINT) AS failed FROM r UNION ALL SELECT TIMESTAMP '2024-02-01 13:00:00', count(*), CAST(sum(new_articles) AS BIGINT), CAST(sum(failed) AS BIGINT) FROM r WHERE source_id % 2 = 0")
def run_totals(spark, d):
    return runs.totals(_runs(spark, d)).select("started_at", "sources", "new_articles", "failed")


@query("candidates_by_path", f"{STORIES} SELECT CASE WHEN id % 3 = 0 THEN 'feed' ELSE 'listing' END AS via, count(*) AS n FROM articles GROUP BY 1")
def candidates_by_path(spark, d):
    return runs.by_path(_candidates(spark, d))


# outputs


@query("health", f"{STORIES} SELECT '{{\"status\":\"' || CASE WHEN max(last_run_at) >= TIMESTAMP '2024-02-01 06:00:00' THEN 'ok' ELSE 'stale' END || '\",\"last_run_at\":\"' || strftime(max(last_run_at), '%Y-%m-%dT%H:%M:%S.000Z') || '\"}}' AS value FROM sources")
def health(spark, d):
    return outputs.health(sources(spark, d), NOW)


@query("sitemap_document", f"{STORIES} SELECT '<url><loc>https://e.com/source/' || s.slug || '</loc><lastmod>' || strftime(max(published_at), '%Y-%m-%dT%H:%M:%SZ') || '</lastmod></url>' AS value FROM articles a JOIN sources s ON s.id = a.source_id GROUP BY s.slug")
def sitemap_document(spark, d):
    times = L.sitemap_times(articles(spark, d), sources(spark, d)).where("kind = 'source'")
    return outputs.sitemap_entries(times, "https://e.com/")


@query("structured_data", r"""SELECT doc_id, '{"name":"a\u003cb\u003e \u0026 ' || doc_id || '"}' AS json FROM documents""")
def structured_data(spark, d):
    return docs(spark, d).select("doc_id", outputs.json_ld(F.struct(joined("a<b> & ", NUMBER()).alias("name"))).alias("json"))


# articles


_PROSE = "This is part {} of the story of {}, and it goes on for long enough to be taken as prose."


@query(
    "extracted_pages",
    """SELECT 'https://www.example.com/s/' || doc_id AS url, 'Story ' || doc_id AS title, CASE WHEN doc_id % 4 > 0 THEN 'https://example.com/c/' || doc_id END AS canonical_url, CASE WHEN doc_id % 3 < 2 THEN 'https://img.example.com/t/' || doc_id || '.jpg' WHEN doc_id % 7 > 0 THEN 'https://www.example.com/b/' || doc_id || '.jpg' END AS image_url,
CASE WHEN doc_id % 5 = 4 THEN TIMESTAMP '2024-01-02 14:00:00' ELSE TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) END AS published_at, 'Ann, Bo' AS author, lang AS section, 'News,' || CASE WHEN lower(lang) = 'news' THEN '' ELSE lang || ',' END || 'c' AS keywords,
'This is part 1 of the story of ' || doc_id || ', and it goes on for long enough to be taken as prose.' || chr(10) || chr(10) || 'This is part 2 of the story of ' || doc_id || ', and it goes on for long enough to be taken as prose.' AS intro, doc_id % 5 < 4 AS is_article FROM documents WHERE lang IS NOT NULL""",
)
def extracted_pages(spark, d):
    """Logos before pictures, garbage before dates, canonical links elsewhere, stories in a container and in the page's state."""
    meta = lambda name, value: joined(f'<meta property="{name}" content="', value, '">')
    prose = [joined(*(x for part in zip(_PROSE.format(n, "|").split("|"), (NUMBER(), ""), strict=True) for x in part if not isinstance(x, str) or x)) for n in (1, 2)]
    head = joined("<html><head><title>x</title>", meta("og:title", joined("Story ", NUMBER(), " - ", F.upper("source"))), meta("og:site_name", F.col("source")), meta("og:image", "https://img.example.com/Logo.png"), by(3, meta("twitter:image", joined("https://img.example.com/t/", NUMBER(), ".jpg")), joined('<link rel="image_src" href="https://img.example.com/t/', NUMBER(), '.jpg">'), ""))
    head = joined(head, '<link rel="canonical" href="', by(4, "https://elsewhere.org/x", joined("https://example.com/c/", NUMBER())), '">', by(5, meta("article:published_time", _ISO()), meta("article:published_time", "soon"), joined('<meta name="date" content="0000">'), meta("article:published_time", _ISO()), ""), meta("article:section", F.col("lang")), meta("article:tag", "News"), meta("keywords", joined("news, ", F.col("lang"), ", NEWS, c, ", "x" * 61)))
    ld = F.when(K() % 5 < 4, joined('<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "datePublished": "', _ISO(), '", "author": [{"name": "Ann"}, {"name": "Bo"}]}]}</script>')).otherwise('<meta name="author" content="By Ann, Bo">')
    junk = "<p>Photo courtesy of the harbour office, which took it on Monday morning</p>"
    held = joined('<div class="article__body">', junk, "<p>", prose[0], '</p><aside><p>A related story that is long enough to be taken as prose, but is none of it.</p></aside><p>', prose[1], '</p><img src="/b/s.gif" width="20"><img data-src="/b/', NUMBER(), '.jpg"></div>')
    state = joined('<div class="article__body"></div><script>window.__PAGE_MODEL__ = {"menu": "Home and news and sports and weather and all of the rest of it, day by day by day", "storyData": {"story": {"content": "<p>', prose[0], "</p><p>", prose[1], '</p>"}}, "pad": "', "x" * 400, '"};</script>')
    page = joined(head, ld, "</head><body>", F.when(K() % 7 == 0, state).otherwise(held), F.when(K() % 5 == 4, "<p>Posted on: January 3, 2024</p>").otherwise(""), "</body></html>")
    rows = docs(spark, d).where("lang IS NOT NULL").select(joined("https://www.example.com/s/", NUMBER()).alias("url"), page.alias("content"))
    return PG.extract_articles(rows, FAR).select("url", "title", "canonical_url", "image_url", "published_at", "author", "section", F.array_join("keywords", ",").alias("keywords"), "intro", "is_article")
