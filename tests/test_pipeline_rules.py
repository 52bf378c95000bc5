"""Sources, ingest rules, state, search and streaming on hand-made tables."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire import config
from tidewire.functions.keywords import Topic
from tidewire.functions import dates, fetching
from tidewire.operators import ingest, jobs, listing, outputs, rounds, runs, state
from tidewire.schemas import SCHEMAS
from tidewire.search import build_postings, engine, search
from tidewire.search.query import parse
from tidewire.sources import apis, boards, pages
from tidewire.streaming import jobs as streaming

NOW = dt.datetime(2026, 10, 30, 12, tzinfo=dt.UTC)
ago = lambda **k: NOW - dt.timedelta(**k)

FEED = """<rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>
<item><title>Storm &amp;amp; sea</title><link>https://news.example.com/2026/10/storm/?utm_source=rss</link><pubDate>Thu, 29 Oct 2026 08:00:00 +1000</pubDate>
<dc:creator>Ana Reyes</dc:creator><category>Weather</category><description>&lt;p&gt;Rain came.&lt;/p&gt; The post Storm appeared first on News.</description><media:content url="https://news.example.com/a.jpg" medium="image"/></item>
<item><title>No link</title><guid>abc</guid></item><item><title>Guid</title><guid>https://news.example.com/guid-story</guid></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://www.reddit.com/r/x/1"/><author><name>/u/me</name></author><content type="html">&lt;div class="md"&gt;&lt;p&gt;Body&lt;/p&gt;&lt;/div&gt;&lt;a href="https://i.redd.it/p.jpg"&gt;[link]&lt;/a&gt;</content></entry></feed>'


def test_feeds(spark):
    df = spark.createDataFrame([("https://news.example.com/feed", FEED), ("https://www.reddit.com/r/x/.rss", ATOM), ("https://b.example.com/f", "<rss><broken"), ("https://c.example.com/f", None)], "url string, content string")
    rows = {r["url"]: r for r in pages.parse_feeds(df, NOW).collect()}
    storm = rows["https://news.example.com/2026/10/storm/"]
    assert (storm["title"], storm["author"], storm["tags"], storm["image_url"]) == ("Storm & sea", "Ana Reyes", ["Weather"], "https://news.example.com/a.jpg")
    assert storm["published_at"] == dt.datetime(2026, 10, 28, 22)
    assert set(rows) == {"https://news.example.com/2026/10/storm/", "https://news.example.com/guid-story", "https://www.reddit.com/r/x/1"}
    post = rows["https://www.reddit.com/r/x/1"]
    assert (post["summary"], post["image_url"], post["author"]) == ("Body", "https://i.redd.it/p.jpg", "u/me")


def test_listing_pages_and_sitemaps(spark):
    page = """<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="application/rss+xml" href="/comments/feed">
    <a href="/2026/10/30/a">short</a><a href="/2026/10/30/a">A long headline for a</a><a href="https://other.org/2026/10/30/b">Other site's long headline</a><a href="/">home</a><a href="/about">About</a><a href="/sports/one-two-three-four-five">Skipped sports headline</a>"""
    df = spark.createDataFrame([("https://www.example.com/news", page)], "url string, content string")
    rows = pages.parse_listings(df, exclude=["/sports/"]).collect()
    assert [(r["url"], r["title"]) for r in rows] == [("https://www.example.com/2026/10/30/a", "A long headline for a")]
    assert [r["url"] for r in pages.advertised_feeds(df).collect()] == ["https://www.example.com/feed"]
    files = {
        "i": '<sitemapindex xmlns="http://s"><sitemap><loc>m-2024.xml</loc></sitemap><sitemap><loc>m-2026.xml</loc></sitemap></sitemapindex>',
        "m-2026.xml": '<urlset xmlns="http://s"><url><loc>https://e.com/1</loc><lastmod>2026-10-01T00:00:00Z</lastmod></url><url><loc>https://e.com/2</loc></url></urlset>',
    }
    fetched = []

    def fetch(urls):
        fetched.extend(urls)
        return spark.createDataFrame([(u, files.get(u)) for u in urls], "url string, content string")

    found = pages.crawled(["i"], fetch, NOW, since=dt.datetime(2026, 1, 1, tzinfo=dt.UTC))
    assert {r["loc"] for r in found.collect()} == {"https://e.com/1", "https://e.com/2"} and fetched == ["i", "m-2026.xml"]
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://e.com/s.xml\nsitemap:",)], "t string")
    assert robots.select(pages.sitemaps_in_robots(F.col("t"))).first()[0] == ["https://e.com/s.xml"]


def test_article_page(spark):
    html = """<html><head><title>Port reopens - Island News</title><meta property="og:site_name" content="Island News"><meta property="article:published_time" content="2026-10-29T08:00:00+10:00"><meta property="og:image" content="https://x.example.com/port.jpg"><link rel="canonical" href="https://www.example.com/port"></head>
    <body><article><p>Advertisement that is long enough to be a paragraph of its own here.</p><p>The port reopened on Thursday after two days of heavy weather, officials said in a statement.</p><p>Ships waited outside the harbour for most of the week, and unloading will take several days.</p></article></body></html>"""
    df = spark.createDataFrame([("https://example.com/p?x=1", html), ("https://example.com/q", None)], "url string, content string")
    a = {r["url"]: r for r in pages.extract_articles(df, NOW).collect()}["https://example.com/p?x=1"]
    assert (a["title"], a["canonical_url"], a["image_url"], a["is_article"]) == ("Port reopens", "https://www.example.com/port", "https://x.example.com/port.jpg", True)
    assert a["intro"].startswith("The port reopened") and "Advertisement" not in a["intro"] and a["published_at"] == dt.datetime(2026, 10, 28, 22)


def test_reddit_and_apis(spark):
    posts = [{"kind": "t3", "data": {"permalink": "/r/x/1/", "title": "A", "url": "https://i.redd.it/a.png", "author": "me", "created_utc": 1792000000.0, "over_18": False}}, {"kind": "t3", "data": {"permalink": "/r/x/2/", "title": "B", "over_18": True}}, {"kind": "t3", "data": {"permalink": "/r/x/3/", "title": "C", "removed_by_category": "mod"}}, {"kind": "t1", "data": {"permalink": "/r/x/4/", "title": "D"}}, {"kind": "t3", "data": {"permalink": "/r/x/5/", "title": "E", "author": "[deleted]", "selftext_html": "<div class='md'>Hi</div>"}}]
    df = spark.createDataFrame([("u", json.dumps({"data": {"children": posts}}))], "url string, content string")
    got = {r["title"]: r for r in apis.parse_posts(df, "x").collect()}
    assert set(got) == {"A", "E"} and got["A"]["image_url"] == "https://i.redd.it/a.png" and got["A"]["author"] == "u/me" and got["E"]["author"] is None and got["E"]["summary"] == "Hi"
    job = {"MatchedObjectDescriptor": {"PositionTitle": "Nurse", "PositionURI": "https://j/1", "OrganizationName": "", "DepartmentName": "VA", "PositionLocation": [{"LocationName": "Guam"}, {"LocationName": "Ohio"}], "PositionRemuneration": [{"MinimumRange": "0", "MaximumRange": "0", "RateIntervalCode": "PA"}, {"MinimumRange": "10", "MaximumRange": "12", "RateIntervalCode": "PH"}], "PublicationStartDate": "2026-10-01T00:00", "ApplicationCloseDate": "2026-11-01T00:00"}}
    r = apis.parse_usajobs(spark.createDataFrame([(json.dumps({"SearchResult": {"SearchResultItems": [job]}}),)], "content string")).first()
    assert (r["title"], r["employer"], r["pay"], r["location"], r["close_date"]) == ("Nurse", "VA", "$10.00 to $12.00 per hour", "Guam", dt.date(2026, 11, 1))
    rows = {"results": [{"announcement_Id": 7, "PositionTitle": "Clerk", "Agency": "DOA", "MIN_SALARY": 1000, "max_salary": 2000}]}
    r = apis.parse_portal(spark.createDataFrame([(json.dumps(rows),)], "content string"), "https://s", "https://a").first()
    assert (r["url"], r["title"], r["employer"], r["pay"], r["close_note"]) == ("https://s#announcement-7", "Clerk", "DOA", "$1,000.00 to $2,000.00", "Open until filled")


def test_boards(spark):
    table = "<table class='table_for_data'><tr><td><a href='/x'>Potter</a></td><td><strong>College</strong></td><td>10/1/2026</td><td>Open until filled</td><td>Open</td><td><a href='https://a.com/job_detail/GJF-1'>d</a></td></tr><tr><td>Old</td><td></td><td></td><td></td><td>Closed</td></tr></table>"
    sections = "<main><h4>Driver</h4><p>Date posted: October 2, 2026</p><p>Pay $15.00 per hour</p><p>Job description: drives.</p><h4>Cook</h4><p>cooks</p></main>"
    read = lambda kind, html, **k: boards.parse_board(spark.createDataFrame([("https://a.com/jobs", html)], "url string, content string"), kind, **k).orderBy("pos").collect()
    (r,) = read("job_table", table)
    assert (r["url"], r["title"], r["employer"], r["open_date"], r["close_note"]) == ("https://a.com/job_detail/GJF-1", "Potter", "College", dt.date(2026, 10, 1), "Open until filled")
    a, b = read("sections", sections, employer="Temps")
    assert (a["url"], a["pay"], a["open_date"], a["description"], a["employer"]) == ("https://a.com/jobs#driver", "$15.00 per hour", dt.date(2026, 10, 2), "drives.", "Temps") and b["pay"] is None
    (r,) = read("pdf_links", "<h2>Harbor Works Job Announcements</h2><a href='/a b.pdf'>Diver</a><a href='/f.pdf'>Application form</a>")
    assert (r["url"], r["employer"]) == ("https://a.com/a%20b.pdf", "Harbor Works")
    (r,) = read("cards", "<div class='job-card'><h3><a href='/v.php?jobid=5&k=1'>Featured Pilot</a></h3><i class='fa fa-usd'></i> 12 hour <i class='fa fa-briefcase'></i> Acme</div>")
    assert (r["url"], r["title"], r["pay"], r["employer"]) == ("https://a.com/v.php?jobid=5", "Pilot", "$12.00 per hour", "Acme")
    assert boards.next_pages("<ul class=pagination><li><a href='?p=2'>2</a></ul>", "https://a.com/j") == ["https://a.com/j?p=2"]
    c = "url string, title string, pdf_url string, reference string"
    twins = spark.createDataFrame([("p1", "Archivist II", None, "112-31"), ("p2", "Porter", None, "113-31"), ("p3", "Porter", None, "114-31"), ("d1", "112-31 Archivist II", "d1", None), ("d2", "Porter", "d2", None)], c)
    assert {r["url"]: r["pdf_url"] for r in jobs.paired_with_pdfs(twins).collect()} == {"p1": "d1", "p2": None, "p3": None, "d2": "d2"}


def test_board_pages_end(spark):
    """A listing of more pages than may be read is not complete; one that was read to its end is."""
    page = lambda k: f"<a rel='next' href='/{k + 1}'>next</a>" if k < 14 else ""
    asked = []

    def fetch(urls):
        asked.extend(urls)
        return spark.createDataFrame([(u, page(int(u.rpartition("/")[2]))) for u in urls], "url string, content string")

    found, whole = boards.board_pages(["https://b.org/0"], fetch)
    assert found.count() == len(asked) == 10 and not whole
    found, whole = boards.board_pages(["https://b.org/12", "https://b.org/13"], fetch)
    assert found.count() == 3 and whole


def test_ingest_round(spark):
    src = spark.createDataFrame([(1, "News", [], ["Sports"], False, False, 30, False, False, None)], "id int, name string, categories array<string>, exclude_sections array<string>, require_place boolean, feed_only boolean, max_age_days int, undated boolean, vouching boolean, only_in_topic string")
    cand = spark.createDataFrame([(1, i, f"https://n.com/{i}", f"https://n.com/{i}", via, title, None, None, at, None, tags) for i, (via, title, at, tags) in enumerate([("feed", "Storm nears", ago(hours=1), []), ("feed", "Game", ago(hours=1), ["sports"]), ("listing", None, None, []), ("listing", "Old page here", ago(days=90), []), ("feed", "Blocked", ago(hours=2), []), ("feed", "Gone", None, []), ("listing", "x", None, [])])], "source_id int, pos int, url string, key string, via string, title string, summary string, image_url string, published_at timestamp, author string, tags array<string>")
    extracted = "canonical_url string, title string, intro string, description string, image_url string, published_at timestamp, author string, section string, keywords array<string>, site_name string, is_article boolean"
    page = lambda i, code, **k: (f"https://n.com/{i}", code, False, k.get("kind", "text/html"), f"https://n.com/{i}", k.get("canonical"), k.get("title"), k.get("intro"), None, k.get("image"), k.get("at"), "Ann of News", None, None, None, k.get("article", True))
    fetched = spark.createDataFrame([page(0, 200, canonical="https://n.com/storm", title="Storm nears island", intro="It rains on the navy.", image="https://n.com/i.jpg"), page(1, 200), page(2, 200, article=False), page(3, 200, title="Old page", at=ago(days=90)), page(4, 403), page(5, 404), page(6, 200, kind="application/pdf")], f"url string, http_status int, robots boolean, content_type string, page_url string, {extracted}")
    topics = [Topic("military", "Military", ("navy",), min_score=1), Topic("local", "Local", ("zzz",), fallback=True)]
    d = ingest.drafts(cand, fetched, src, topics, (), NOW)
    got = {r["pos"]: r for r in d.collect()}
    assert {k: (r["status"], r["reason"]) for k, r in got.items()} == {0: ("ok", None), 1: ("rejected", "excluded section: sports"), 2: ("rejected", "not an article page"), 3: ("rejected", "older than 30 days"), 4: ("ok", None), 5: ("rejected", "gone (404)"), 6: ("rejected", "not HTML (application/pdf)")}
    assert (got[0]["url"], got[0]["discovered_url"], got[0]["categories"], got[0]["author"]) == ("https://n.com/storm", "https://n.com/0", ["military"], "Ann") and got[4]["categories"] == ["local"]
    none = spark.createDataFrame([], SCHEMAS["articles"])
    stored, dupes = state.stored_articles(none, d, NOW)
    assert [r["id"] for r in stored.orderBy("id").collect()] == [1, 2] and dupes.count() == 0
    again, dupes = state.stored_articles(stored, d, NOW)
    assert again.count() == 2 and dupes.count() == 2
    seen = state.remembered(spark.createDataFrame([], SCHEMAS["seen_urls"]), d.select(F.col("key").alias("url"), "source_id", "status", "reason"), NOW)
    assert {r["status"] for r in seen.collect()} == {"rejected"} and seen.count() == 5
    assert ingest.filter_new(cand, stored, seen, NOW).count() == 0  # a second round fetches nothing


def test_two_rounds(spark, tmp_path):
    """A round stores, rejects, remembers and leaves pages pending; the next one goes on with those and tries a failed one again."""
    src = spark.createDataFrame([(1, "News", [], ["Sports"], False, False, 30, False, False, None), (2, "Club", [], [], False, False, 30, False, False, None)], "id int, name string, categories array<string>, exclude_sections array<string>, require_place boolean, feed_only boolean, max_age_days int, undated boolean, vouching boolean, only_in_topic string")
    c = "source_id int, pos int, url string, key string, via string, title string, summary string, image_url string, published_at timestamp, author string, tags array<string>"
    cand = lambda rows: spark.createDataFrame([(s, i, f"https://n.com/{k}", f"https://n.com/{k}", "feed", k, None, img, ago(hours=i + 1), None, tags) for i, (s, k, img, tags) in enumerate(rows)], c)
    extracted = "canonical_url string, title string, intro string, description string, image_url string, published_at timestamp, author string, section string, keywords array<string>, site_name string, is_article boolean"
    log = f"url string, http_status int, robots boolean, content_type string, page_url string, {extracted}"
    asked = []

    def fetch(rows):
        keys = sorted(r["key"] for r in rows.collect())
        asked.append([k[-1] for k in keys])
        page = lambda k: (k, 500 if k.endswith("f") else 200, False, "text/html", k, "https://n.com/a" if k.endswith("d") else None, f"Title {k[-1]}", None, None, None, None, None, None, None, None, True)
        return spark.createDataFrame([page(k) for k in keys], log)

    empty = rounds.Tables(*(spark.createDataFrame([], x) for x in (SCHEMAS["articles"], SCHEMAS["seen_urls"], c, SCHEMAS["ignored_images"], SCHEMAS["scrape_runs"])))

    def keep(rows, name):
        path = f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}"
        rows.coalesce(1).write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def ingest_round(tables, found, now):
        after = rounds.ingest_round(tables, found, fetch, src, [], (), now, most=3, keep=keep)
        return rounds.Tables(*(keep(x, k) for k, x in vars(after).items()))

    first = ingest_round(empty, cand([(1, "a", None, []), (1, "f", None, []), (1, "s", None, ["sports"]), (1, "p", None, []), (1, "q", None, []), (2, "d", None, [])]), NOW)
    held = lambda df, *cols: sorted(tuple(r[x] for x in cols) for r in df.collect())
    assert asked == [["a", "d", "f", "p"]]
    assert held(first.articles, "url") == [("https://n.com/a",), ("https://n.com/p",)] and held(first.pending, "title") == [("q",)]
    assert held(first.seen, "url", "status", "attempts") == [("https://n.com/d", "rejected", 1), ("https://n.com/f", "failed", 1), ("https://n.com/s", "rejected", 1)]
    assert held(first.runs, "source_id", "candidates", "new_articles", "failed") == [(1, 4, 2, 1), (2, 1, 0, 0)] and first.runs.where("finished_at IS NULL").count() == 0
    later = NOW + dt.timedelta(hours=2)
    second = ingest_round(first, cand([(1, "a", None, []), (1, "s", None, ["sports"])]), later)
    assert asked[1] == ["f", "q"] and second.articles.count() == 3 and second.pending.count() == 0
    assert ("https://n.com/f", 2) in held(second.seen, "url", "attempts") and sorted(r["id"] for r in second.runs.collect()) == [1, 2, 3]
    assert held(runs.totals(second.runs), "sources", "new_articles") == [(1, 1), (2, 2)]
    assert held(runs.by_path(cand([(1, "a", None, [])])), "via", "n") == [("feed", 1)]


def test_rounds_over_a_folder(spark, tmp_path):
    """Two rounds and a change of topics over stored tables, from feeds and a fetch log to stories."""
    cats = {"categories": [{"slug": "sea", "name": "Sea", "keywords": ["storm"], "min_score": 1}, {"slug": "local", "name": "Local", "keywords": ["zzz"], "fallback": True}]}
    c = config.load({"sources": [{"slug": "news", "name": "News", "feeds": "https://news.example.com/feed"}]}, cats)
    html = "<html><head><meta property='og:title' content='{0}'><meta property='article:published_time' content='2026-10-29T08:00:00Z'></head><body><article><p>The storm of the week passed over the island on Thursday, and the harbour opened again. {0} was all that was asked for by those who had to wait for it.</p></article></body></html>"
    at = ["https://news.example.com/2026/10/storm/", "https://news.example.com/guid-story"]
    log = spark.createDataFrame([(u, 200 if i == 0 else 500, False, "text/html", u, html.format("Storm & sea")) for i, u in enumerate(at)], "url string, http_status int, robots boolean, content_type string, page_url string, content string")
    feeds = spark.createDataFrame([("news", "feed", "https://news.example.com/feed", FEED)], "slug string, kind string, url string, content string")
    folder = f"file://{tmp_path}/state"
    n = rounds.run_round(spark, folder, feeds, log, c, NOW)
    assert (n["articles"], n["seen"], n["pending"], n["runs"], n["sources"]) == (1, 1, 0, 1, 1)
    story = rounds.stored_tables(spark, folder)["articles"].read().first()
    assert (story["url"], story["title"], story["categories"]) == (at[0], "Storm & sea", ["sea"])
    n = rounds.run_round(spark, folder, feeds, log, c, NOW + dt.timedelta(hours=2))
    assert (n["articles"], n["runs"]) == (1, 2) and rounds.stored_tables(spark, folder)["seen"].read().first()["attempts"] == 2
    cats["categories"][0]["keywords"] = ["snow"]
    assert rounds.reclassify(spark, folder, config.load({"sources": [{"slug": "news", "name": "News", "feeds": "https://news.example.com/feed"}]}, cats)) == 1
    assert rounds.stored_tables(spark, folder)["articles"].read().first()["categories"] == ["local"]


def test_board_check_over_a_folder(spark, tmp_path):
    row = "<tr><td><a href='/x'>{0}</a></td><td><strong>College</strong></td><td>10/1/2026</td><td>Open until filled</td><td>Open</td><td><a href='https://a.com/job_detail/{0}'>d</a></td></tr>"
    page = lambda *names: spark.createDataFrame([("https://a.com/jobs", "<table id='example'>" + "".join(map(row.format, names)) + "</table>")], "url string, content string")
    folder = f"file://{tmp_path}/state"
    assert jobs.check_board(spark, folder, "job_table", page("a", "b"), 1, NOW) == 2
    assert jobs.check_board(spark, folder, "job_table", page("b", "c"), 1, NOW + dt.timedelta(days=1)) == 3
    stored = state.VersionedTable(spark, f"{folder}/jobs", SCHEMAS["jobs"]).read().collect()
    assert {(r["title"], r["removed_at"] is not None) for r in stored} == {("a", True), ("b", False), ("c", False)} and len({r["id"] for r in stored}) == 3


def test_fetching_rules():
    told, slept = [], []

    def send(url, headers):
        told.append((url, headers))
        answers = {"/old": (301, {"Location": "/new"}, b""), "/new": (200, {"ETag": "x"}, b"body"), "/same": (304, {}, b""), "/busy": (503, {"Retry-After": "3"}, b""), "/big": (200, {}, b"x" * (fetching.MOST_BYTES + 1)), "/loop": (302, {"location": "/loop"}, b""), "/later": (429, {"retry-after": "900"}, b"")}
        if url.endswith("/down"):
            raise ConnectionError
        return answers[url.removeprefix("https://e.com")]

    ask = lambda path, cached=None: fetching.fetched(send, f"https://e.com{path}", cached, lambda: NOW, slept.append, lambda host: ["93.184.216.34"])
    a = ask("/old")
    assert (a.http_status, a.final_url, a.body, a.unchanged) == (200, "https://e.com/new", b"body", False)
    assert ask("/new", {"content_hash": a.content_hash, "etag": "x"}).unchanged and told[-1][1] == {"if-none-match": "x"} and ask("/same").unchanged
    assert ask("/busy").http_status == 503 and slept == [3.0, 3.0]
    assert ask("/big").http_status is None and ask("/loop").http_status == 302 and ask("/later").http_status == 429 and slept == [3.0, 3.0]
    assert ask("/down").http_status is None and slept[2:] == [1.0, 2.0]
    clock, made = [0.0], []
    token = fetching.Token(lambda: made.append(1) or (f"t{len(made)}", 100.0), lambda: clock[0])
    assert token.get() == token.get() == "t1"
    clock[0] = 41
    assert token.get() == "t2"
    refused = [401, 200]
    assert token.ask(lambda u, h: (refused.pop(0), h, b""), "u")[1] == {"authorization": "bearer t3"}
    assert token.ask(lambda u, h: (401, {}, b""), "u")[0] == 401
    kept = fetching.Kept(10, lambda: clock[0])
    assert [kept.get("a", lambda: clock[0]), kept.get("b", lambda: 2)] == [41, 2]
    clock[0] = 50.5
    assert kept.get("a", lambda: clock[0]) == 41
    clock[0] = 51.0
    assert kept.get("a", lambda: clock[0]) == 51.0


def test_labels_of_times(spark):
    at = [NOW - dt.timedelta(seconds=30), NOW - dt.timedelta(minutes=5), NOW - dt.timedelta(minutes=70), NOW - dt.timedelta(hours=5), NOW - dt.timedelta(hours=30), NOW - dt.timedelta(days=9), NOW - dt.timedelta(days=400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp").orderBy("i")
    assert [r[0] for r in df.select(dates.relative_time(F.col("t"), NOW)).collect()] == ["just now", "5 min ago", "1 hr ago", "5 hrs ago", "yesterday", "Oct 21", "Sep 25, 2025"]
    assert df.select(dates.local_datetime(F.col("t"))).first()[0] == "Oct 30, 2026, 9:59 PM ChST"
    days = spark.createDataFrame([(dt.date(2026, 10, 30),), (dt.date(2026, 10, 29),), (dt.date(2026, 10, 3),)], "d date")
    assert [r[0] for r in days.select(dates.day_label(F.col("d"), dt.date(2026, 10, 30))).collect()] == ["Today · Friday, October 30, 2026", "Yesterday · Thursday, October 29, 2026", "Saturday, October 3, 2026"]


def test_backup_keeps_the_latest(spark, tmp_path):
    rows = spark.range(3)
    kept = [outputs.backup({"t": rows}, f"file://{tmp_path}/b", stamp, keep=2) for stamp in ("2026-01-01", "2026-01-02", "2026-01-03")]
    assert kept[-1] == ["2026-01-02", "2026-01-03"] and not (tmp_path / "b/2026-01-01").exists() and spark.read.parquet(f"file://{tmp_path}/b/2026-01-03/t").count() == 3


def test_backoff(spark):
    rows = [(f"u{n}-{h}", 1, "failed", "x", n, NOW, ago(hours=h)) for n in (1, 2, 3, 4, 5) for h in (1, 2, 4, 8)] + [("r", 1, "rejected", "x", 1, NOW, ago(days=9))]
    seen = spark.createDataFrame(rows, SCHEMAS["seen_urls"])
    assert {r["url"] for r in ingest.retries(seen, NOW).collect()} == {f"u{n}-{h}" for n in (1, 2, 3, 4) for h in (1, 2, 4, 8) if h >= 2 ** (n - 1)}


def test_images(spark):
    a = spark.createDataFrame([(1, "logo", ago(days=1)), (1, "logo", ago(days=2)), (1, "old", ago(days=99)), (1, "old", ago(days=99)), (2, "logo", ago(days=1))], "source_id int, image_url string, published_at timestamp")
    new = spark.createDataFrame([(1, "logo", NOW), (1, "old", NOW), (2, "logo", NOW)], "source_id int, image_url string, published_at timestamp")
    none = spark.createDataFrame([], SCHEMAS["ignored_images"])
    generic = ingest.reused_images(a, new, none, NOW)
    assert [tuple(r) for r in generic.select("source_id", "image_url").collect()] == [(1, "logo")]
    assert ingest.without_images(a, generic).where("image_url IS NULL").count() == 2


def test_job_check(spark):
    old = spark.createDataFrame([(1, 1, "a", "A", "E", None, None, None, dt.date(2026, 1, 1), None, None, None, ago(days=5), ago(days=5), None, None), (2, 1, "b", "B", None, None, None, None, None, None, None, None, ago(days=5), ago(days=5), None, None), (3, 2, "c", "C", None, None, None, None, None, None, None, None, ago(days=5), ago(days=5), None, None)], SCHEMAS["jobs"])
    listed = spark.createDataFrame([("a", "A2", "", None, None, None, None, None, None, None), ("n", "N", None, None, None, None, None, None, None, None), ("c", "C", None, None, None, None, None, None, None, None)], "url string, title string, employer string, pay string, description string, location string, open_date date, close_date date, close_note string, pdf_url string")
    got = {r["url"]: r for r in jobs.reconciled(old, listed, 1, NOW).collect()}
    assert (got["a"]["title"], got["a"]["employer"], got["a"]["open_date"], got["a"]["id"]) == ("A2", "E", dt.date(2026, 1, 1), 1)
    assert got["b"]["removed_at"] and not got["a"]["removed_at"] and got["n"]["id"] == 4 and got["c"]["source_id"] == 2 and len(got) == 4
    assert all(r["removed_at"] is None for r in jobs.reconciled(old, listed, 1, NOW, complete=False).collect())


def test_upserted_takes_the_last(spark):
    c = "k int, at int, v string"
    old, new = spark.createDataFrame([(1, 0, "old"), (2, 0, "kept")], c), spark.createDataFrame([(1, 1, "early"), (1, 2, "late"), (3, 5, "a"), (3, 5, "b"), (4, None, "none"), (4, 1, "one")], c)
    rows = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert rows(state.upserted(old, new, "k", F.col("at"))) == [(1, "late"), (2, "kept"), (3, "b"), (4, "one")]
    assert rows(state.upserted(old, new, "k")) == rows(state.upserted(old, new.repartition(4), "k")) == [(1, "late"), (2, "kept"), (3, "b"), (4, "one")]


def test_remembered_counts_every_outcome(spark):
    seen = spark.createDataFrame([("a", 1, "failed", "old", 1, ago(days=1), ago(days=1)), ("b", 1, "failed", "old", 4, ago(days=1), ago(days=1)), ("t", 1, "failed", "old", 2, ago(days=1), ago(days=1))], SCHEMAS["seen_urls"])
    out = spark.createDataFrame([("a", 1, "ok", None), ("a", 1, "rejected", "duplicate"), ("b", 1, "failed", "x"), ("b", 2, "failed", "y"), ("c", 2, "failed", "z"), ("c", 2, "rejected", "no"), ("t", 1, "throttled", "slow"), ("n", 1, "throttled", "slow")], "url string, source_id int, status string, reason string")
    got = {r["url"]: (r["status"], r["reason"], r["attempts"]) for r in state.remembered(seen, out, NOW).collect()}
    assert got == {"b": ("failed", "y", 6), "c": ("rejected", "no", 2), "t": ("failed", "old", 2)}


def test_numbers_and_configuration(spark):
    rows = spark.createDataFrame([(s, p) for s in (3, 1, None) for p in (5, 2, 9)], "s int, p int")
    got = sorted((r["id"], r["s"], r["p"]) for r in state.numbered(rows, F.col("s"), [F.col("p")], 10).collect())
    assert got == [(11 + i, s, p) for i, (s, p) in enumerate((s, p) for s in (None, 1, 3) for p in (2, 5, 9))]
    stored = spark.createDataFrame([(4, "a", "A", True), (7, "b", "B", True)], "id int, slug string, name string, enabled boolean")
    conf = spark.createDataFrame([("b", "B2", True), ("c", "C", False), ("d", "D", True)], "slug string, name string, enabled boolean")
    got = {r["slug"]: (r["id"], r["name"], r["enabled"]) for r in state.synced(stored, conf).collect()}
    assert got["a"] == (4, "A", False) and got["b"] == (7, "B2", True) and {got["c"][0], got["d"][0]} == {8, 9} and got["c"][1:] == ("C", False)


def stories(spark):
    rows = [(1, 1, "u1", "Fares rise in Málaga", "A ferry timetable changes fares. Monsoon season ends.", ["labor"], ago(days=1)), (2, 1, "u2", "Ferry timetable grows", "Firms look for boats.", ["labor", "business"], ago(days=400)), (3, 2, "u3", "Lighthouse Marconi opens gate", "The gate is new.", ["military"], ago(days=2))]
    a = spark.createDataFrame(rows, "id long, source_id int, url string, title string, intro string, categories array<string>, published_at timestamp")
    a = a.withColumns({c: F.lit(None).cast("string") for c in ("keywords", "section", "author", "image_url")})
    s = spark.createDataFrame([(1, "daily", "Daily", "h", True), (2, "club", "Club", "h", True)], "id int, slug string, name string, homepage string, enabled boolean")
    return a, s


def test_search(spark):
    a, s = stories(spark)
    p = build_postings(a)
    find = lambda q, **k: search(a, s, p, listing.Filters(q=q, **k), NOW)
    page, fuzzy = find('"ferry timetable" -monsoon')
    assert [r["id"] for r in page.items.collect()] == [2] and not fuzzy
    (row,) = find("malaga fare")[0].items.collect()
    assert row["title_marked"] == "⟦Fares⟧ rise in ⟦Málaga⟧"
    page, fuzzy = find("Marcon")
    assert fuzzy and [r["id"] for r in page.items.collect()] == [3] and page.total == 1
    assert [r["id"] for r in find("ferry timetable", sort="oldest")[0].items.collect()] == [2, 1]
    assert [r["id"] for r in find("gate or fare", hide_sources=("club",))[0].items.collect()] == [1]
    assert [r["id"] for r in find("-gate", sort="newest")[0].items.collect()] == [1, 2]
    assert find("", category="labor")[0].total == 2 and find("zzzz")[1] is False


def test_stored_postings_are_pruned(spark, tmp_path):
    """A query opens the buckets of its terms, and finds the same as over postings that were just made."""
    a, _ = stories(spark)
    fresh = build_postings(a)
    stored = engine.write_postings(fresh, "pruned_postings", 8, f"file://{tmp_path}/p")
    shown = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # without it the plan doesn't tell the buckets, though it prunes them
    spark.conf.set(shown, "false")
    for q in ("gate", '"ferry timetable" -monsoon', "gate or fare"):
        found, plain = (engine.matched(a, p, parse(q)) for p in (stored, fresh))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: " in plan and "SelectedBucketsCount: 8" not in plan
    spark.conf.unset(shown)
    spark.sql("DROP TABLE pruned_postings")


def test_word_similarity_by_hand():
    """Against every stretch of the title's trigrams."""
    rng = random.Random(3)
    for _ in range(300):
        q, t = (" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(2))
        wanted = {g for w in q.split() for g in engine.trigrams(w)}
        have = [g for w in t.split() for g in engine.trigrams(w)]
        best = max((len(wanted & set(have[i:j])) / len(wanted | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=0.0)
        assert engine.word_similarity(q, t) == pytest.approx(best if best >= 0.3 else 0.0)


def test_pages_of_a_listing(spark):
    a, s = stories(spark)
    every = [r["id"] for k in (1, 2) for r in listing.list_articles(a, s, listing.Filters(sort="newest"), k, 2).items.collect()]
    assert every == [1, 3, 2]
    assert listing.Page(a, 600, 6, 30).window() == [1, None, 4, 5, 6, 7, 8, None, 20]
    with pytest.raises(ValueError):
        listing.Filters(sort="best")
    plan = listing.list_articles(a, s, listing.Filters(hide_sources=("club",))).items._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LeftAnti" in plan


def test_config():
    cats = {"categories": [{"slug": "local", "keywords": ["police"], "fallback": True}, {"slug": "club", "name": "Club"}]}
    good = {"defaults": {"exclude_sections": ["Sports", "Opinion"], "exclude_url_patterns": ["/sports/", "/tag/"]}, "sources": [{"slug": "a", "name": "A", "feeds": "https://a.com/f", "allow_sections": ["Sports"], "only_in_topic": "club"}]}
    c = config.load(good, cats, {"boards": [{"slug": "b", "parser": "portal"}]})
    assert c.sources[0].exclude_sections == ("Opinion",) and c.sources[0].exclude_url_patterns == ("/tag/",) and c.hidden == ("a",) and c.boards[0].name == "b"
    for bad in ({"slug": "A!", "name": "x"}, {"slug": "a"}, {"slug": "a", "name": "x"}, {"slug": "a", "name": "x", "feeds": "f", "categories": ["no"]}, {"slug": "a", "name": "x", "feeds": "f", "article_pattern": "("}, {"slug": "a", "name": "x", "feeds": "f", "undated": True}):
        with pytest.raises(config.ConfigError):
            config.load({"sources": [bad]}, cats)


def test_streams(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("u1", "failed", at), ("u1", "failed", at + dt.timedelta(hours=2)), ("u2", "ok", at), ("u3", "rejected", at)]
    spark.createDataFrame(rows, "url string, status string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, status string, at timestamp").parquet(str(tmp_path / "in"))
    q = streaming.retry_memory(stream).writeStream.outputMode("update").format("memory").queryName("retry").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["url"]: r for r in spark.table("retry").collect()}
    assert got["u1"]["attempts"] == 2 and got["u1"]["due_at"] == at + dt.timedelta(hours=4) and got["u3"]["due_at"] is None and got["u2"]["status"] == "ok"
    table = state.VersionedTable(spark, f"file://{tmp_path}/t", "url string, status string")
    merge = lambda old, new: state.upserted(old, new.select("url", "status"), "url")
    streaming.upsert_stream(stream, table, merge, str(tmp_path / "c2")).awaitTermination()
    assert table.read().count() == 3 and table.last_batch == 0 and table.version == 1
    # the batch is delivered again: its commit is lost, its version isn't
    for f in (tmp_path / "c2/commits").glob("*0*"):
        f.unlink()
    streaming.upsert_stream(stream, table, merge, str(tmp_path / "c2")).awaitTermination()
    assert table.version == 1


def test_crawled_prunes_before_it_limits(spark):
    """More children of earlier years, and seen ones, than may be fetched: the recent ones are reached all the same."""
    children = ["https://e.com/i.xml", *(f"https://e.com/a{k}-2019.xml" for k in range(30)), "https://e.com/z-2026.xml", "https://e.com/z.xml"]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in children) + "</sitemapindex>"
    asked = []

    def fetch(urls):
        asked.extend(urls)
        page = lambda u: index if u.endswith("i.xml") else f"<urlset><url><loc>{u}/story</loc></url></urlset>"
        return spark.createDataFrame([(u, page(u)) for u in urls], "url string, content string")

    found = pages.crawled(["https://e.com/i.xml"], fetch, NOW, since=dt.datetime(2026, 1, 1, tzinfo=dt.UTC), most=3)
    assert asked == ["https://e.com/i.xml", "https://e.com/z-2026.xml", "https://e.com/z.xml"]
    assert {r["loc"] for r in found.collect()} == {"https://e.com/z-2026.xml/story", "https://e.com/z.xml/story"}


def test_bot_check(spark):
    pages_ = [
        ({"x-amzn-waf-action": "challenge"}, 405, "<html>x</html>", "AWS WAF"),
        ({}, 202, "<p>JavaScript is disabled</p><script src='/awswaf/c.js'>", "AWS WAF"),
        ({}, 200, "<title>One moment, please</title>/.well-known/sgcaptcha/", "SiteGround"),
        ({"server": "AkamaiGHost"}, 403, "<TITLE>Access Denied</TITLE>", "Akamai"),
        ({}, 403, "<title>DDoS-Guard</title>", "DDoS-Guard"),
        ({"server": "cloudflare"}, 200, " " * 30_000 + "<title>Just a moment...</title>", "Cloudflare"),
        ({"content-type": "text/html; charset=utf-8"}, 200, "<title> Checking your browser</title>", "unknown"),
        ({"content-type": "application/json"}, 200, "<title>Please wait</title>", None),
        ({}, 200, "<title>Please wait</title>" + "x" * 200_000, None),
        ({"cf-ray": "1", "server": "cloudflare"}, 200, "<title>News</title>", None),
        ({"cf-mitigated": "challenge"}, 403, None, "Cloudflare"),
        ({}, None, None, None),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages_)], "i int, h map<string,string>, s int, b string, e string")
    assert [r[0] for r in df.orderBy("i").select(ingest.bot_check(F.col("h"), F.col("s"), F.col("b"))).collect()] == [p[3] for p in pages_]
