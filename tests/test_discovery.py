"""A round over every kind of page, twice; what is unchanged gives nothing; addresses that may not be asked; boards with details."""

from __future__ import annotations

import datetime as dt
import json

from tidewire import config
from tidewire.functions import fetching
from tidewire.operators import jobs, rounds
from tidewire.schemas import SCHEMAS
from tidewire.search import SearchIndex

NOW = dt.datetime(2026, 10, 30, 12, tzinfo=dt.UTC)
CATS = {"categories": [{"slug": "local", "name": "Local", "keywords": ["police"], "fallback": True}, {"slug": "sea", "name": "Sea", "keywords": ["storm"]}]}
STORY = "<html><head><meta property='og:title' content='{0}'><meta property='og:type' content='article'><meta property='article:published_time' content='2026-10-29T08:00:00Z'></head><body><article><p>The storm of the week passed over the island on Thursday, and the harbour opened again. {0} was all that was asked for by those who had to wait for it.</p></article></body></html>"


def entry(url):
    return f"<item><title>{url.rsplit('/', 1)[-1]}</title><link>{url}</link><pubDate>Thu, 29 Oct 2026 08:00:00 GMT</pubDate><description>About the storm of the week, which passed over the island on Thursday morning.</description></item>"


def test_rounds_over_every_kind_of_page(spark, tmp_path):
    c = config.load(
        {
            "sources": [
                {"slug": "news", "name": "News", "homepage": "https://news.example.com", "feeds": "https://news.example.com/feed", "listing_pages": "https://news.example.com/", "autodiscover_feeds": True, "exclude_url_patterns": ["/sports/"], "article_pattern": "/story/"},
                {"slug": "forum", "name": "Forum", "reddit": "island", "feed_only": True},
            ]
        },
        CATS,
    )
    at = "https://news.example.com"
    listing = f"<link rel=alternate type='application/rss+xml' href='/more/feed'><link rel=alternate type='application/rss+xml' href='/feed'><a href='/story/from-listing'>A headline that is long enough</a><a href='/story/sports/x'>s</a><a href='/sports/story/no'>Not this one, it is excluded</a><a href='/about'>About</a><a href='https://else.example.org/story/x'>Elsewhere</a>"
    feed = f"<rss><channel>{entry(at + '/story/from-feed')}{entry('https://off.example.org/story/off')}{entry(at + '/sports/story/no')}</channel></rss>"
    more = f"<rss><channel>{entry(at + '/story/advertised')}</channel></rss>"
    maps = f"<urlset><url><loc>{at}/story/from-map</loc></url><url><loc>{at}/contact</loc></url></urlset>"
    posts = json.dumps({"data": {"children": [{"kind": "t3", "data": {"permalink": "/r/island/comments/1/x/", "title": "A storm is coming to us", "selftext_html": "&lt;p&gt;It will be here by noon and everybody should stay at home.&lt;/p&gt;", "author": "m", "created_utc": 1793260000.0}}]}})
    pages = [("news", "feed", f"{at}/feed", feed), ("news", "listing", f"{at}/", listing), ("news", "sitemap", f"{at}/sitemap.xml", maps), ("forum", "posts", "https://www.reddit.com/r/island/new.json", posts)]
    read = lambda rows: spark.createDataFrame(rows, "slug string, kind string, url string, content string")
    stories = ["from-listing", "from-feed", "advertised", "from-map", "second"]
    log = [(f"{at}/story/{s}", 200, False, "text/html", f"{at}/story/{s}", STORY.format(s.title())) for s in stories] + [(f"{at}/more/feed", 200, False, "text/xml", f"{at}/more/feed", more)]
    log = spark.createDataFrame(log, "url string, http_status int, robots boolean, content_type string, page_url string, content string")
    folder = f"file://{tmp_path}/state"
    n = rounds.run_round(spark, folder, read(pages), log, c, NOW)
    tables = rounds.stored_tables(spark, folder)
    urls = {r["url"] for r in tables["articles"].read().collect()}
    assert urls == {f"{at}/story/{s}" for s in stories[:4]} | {"https://www.reddit.com/r/island/comments/1/x"} or {u.rstrip("/") for u in urls} == {f"{at}/story/{s}" for s in stories[:4]} | {"https://www.reddit.com/r/island/comments/1/x"}
    assert n["http_cache"] == 4 and n["pending"] == 0
    # nothing has changed: only the listing page, which may advertise other feeds, is read again, and it has nothing new
    again = rounds.run_round(spark, folder, read(pages), log, c, NOW + dt.timedelta(hours=1))
    assert again["articles"] == n["articles"] and again["seen"] == n["seen"]
    # the feed is not modified, the sitemap is another
    third = read([("news", "sitemap", f"{at}/sitemap.xml", maps.replace("from-map", "second")), ("news", "feed", f"{at}/feed", None)])
    third = third.selectExpr("*", "CASE WHEN kind = 'feed' THEN 304 ELSE 200 END AS http_status", "'e1' AS etag", "CAST(NULL AS STRING) AS last_modified")
    last = rounds.run_round(spark, folder, third, log, c, NOW + dt.timedelta(hours=2))
    assert last["articles"] == n["articles"] + 1
    assert {r["url"]: r["etag"] for r in tables["http_cache"].read().collect()}[f"{at}/sitemap.xml"] == "e1"
    # the search index follows the stories: only new ones are analysed
    index = SearchIndex(spark, f"file://{tmp_path}/index", 4)
    assert index.follow(tables["articles"].read()) == 1 and index.follow(tables["articles"].read()) == 1
    assert index.postings().where("term = 'storm'").count() >= 5


def test_what_is_pending_is_not_remembered_as_read(spark, tmp_path):
    c = config.load({"sources": [{"slug": "news", "name": "News", "feeds": "https://n.example.com/feed"}]}, CATS)
    feed = "<rss><channel>" + "".join(entry(f"https://n.example.com/story-of-the-{i}") for i in range(3)) + "</channel></rss>"
    pages = spark.createDataFrame([("news", "feed", "https://n.example.com/feed", feed)], "slug string, kind string, url string, content string")
    log = spark.createDataFrame([(f"https://n.example.com/story-of-the-{i}", 200, False, "text/html", f"https://n.example.com/story-of-the-{i}", STORY.format(f"S{i}")) for i in range(3)], "url string, http_status int, robots boolean, content_type string, page_url string, content string")
    folder = f"file://{tmp_path}/state"
    counts = [rounds.run_round(spark, folder, pages, log, c, NOW + dt.timedelta(hours=h), most=2) for h in range(2)]
    assert [n["articles"] for n in counts] == [2, 3] and [n["pending"] for n in counts] == [1, 0] and [n["http_cache"] for n in counts] == [0, 1]


def test_only_public_addresses_are_asked():
    hosts = {"ok.com": ["93.184.216.34"], "in.com": ["10.0.0.1"], "mixed.com": ["93.184.216.34", "127.0.0.1"], "none.com": []}
    asked = []

    def send(url, headers):
        asked.append(url)
        return {"https://ok.com/in": (302, {"location": "http://in.com/x"}, b""), "https://ok.com/up": (302, {"location": "//[::1]/"}, b""), "https://ok.com/file": (302, {"location": "file:///etc/passwd"}, b"")}.get(url, (200, {}, b"x"))

    ask = lambda url: fetching.fetched(send, url, resolve=lambda h: hosts.get(h, [])).http_status
    assert ask("https://ok.com/") == 200 and ask("https://8.8.8.8/") == 200
    n = len(asked)
    assert [ask(u) for u in ("http://in.com/", "https://mixed.com/", "https://none.com/", "http://127.0.0.1/", "http://[::ffff:10.0.0.1]/", "ftp://ok.com/", "https:///x", "http://169.254.169.254/latest")] == [None] * 8
    assert len(asked) == n  # nobody was asked
    assert [ask(f"https://ok.com/{p}") for p in ("in", "up", "file")] == [None] * 3 and len(asked) == n + 3  # the first hop only


def test_a_body_is_read_up_to_its_limit():
    read = []

    def chunks():
        for i in range(1000):
            read.append(i)
            yield b"x" * (1 << 20)

    ask = lambda body: fetching.fetched(lambda u, h: (200, {}, body), "https://ok.com/", resolve=lambda h: ["8.8.8.8"])
    assert ask(chunks()).http_status is None and len(read) == 11
    answer = ask(iter([b"ab", b"c"]))
    assert answer.body == b"abc" and answer.content_hash and ask(b"").body == b""


def test_board_with_details(spark, tmp_path):
    card = "<div class='job-card'><h2><a href='https://b.com/v.php?jobid={0}'>Job {0}</a></h2><p>Short.</p></div>"
    pages = spark.createDataFrame([("https://b.com/1", card.format(1) + card.format(2)), ("https://b.com/2", card.format(3))], "url string, content string")
    own = spark.createDataFrame([("https://b.com/v.php?jobid=1", "<div><h2>Job: One</h2><p>Do all that has to be done.</p></div>")], "url string, content string")
    folder = f"file://{tmp_path}/state"
    assert jobs.check_board(spark, folder, "cards", pages, 1, NOW) == 3
    assert jobs.check_board(spark, folder, "cards", pages, 1, NOW + dt.timedelta(hours=6), details=own) == 3
    table = jobs.BucketedTable(spark, f"{folder}/jobs", SCHEMAS["jobs"], "url")
    got = {r["title"]: (r["description"], r["detail_fetched_at"] is not None) for r in table.read().collect()}
    assert got == {"Job 1": ("Do all that has to be done.", True), "Job 2": ("Short.", False), "Job 3": ("Short.", False)}
    assert jobs.check_board(spark, folder, "cards", pages.where("url = 'https://b.com/1'"), 1, NOW + dt.timedelta(hours=12)) == 3
    last = {r["title"]: (r["removed_at"] is not None, r["detail_fetched_at"] is not None) for r in table.read().collect()}
    assert last == {"Job 1": (False, True), "Job 2": (False, False), "Job 3": (True, False)}
